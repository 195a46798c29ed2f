"""Raw observations to clean segments: decode, parse, clip, deduplicate, account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions import geo, observe
from roadweave.operators.ordering import first_by

# Reasons for dropping a feature, in the order they are checked.
DROP_REASONS = (
    "missing_geometry", "unsupported_geometry_type", "empty_geometry_lines", "short_geometry_line",
    "invalid_geometry_point", "missing_speed_property",
)


def decode_features(features: DataFrame) -> DataFrame:
    """Tile features to segments; ``drop_reason`` names the first failing rule and is null for kept rows."""
    line = geo.longest_line(F.col("coordinates"))
    current = observe.first_prop_double(F.col("properties"), observe.CURRENT_SPEED_KEYS)
    reason = (
        F.when(F.col("geom_type").isNull(), DROP_REASONS[0])
        .when(~F.col("geom_type").isin("LineString", "MultiLineString"), DROP_REASONS[1])
        .when(F.coalesce(F.size("coordinates"), F.lit(0)) <= 0, DROP_REASONS[2])
        .when(F.coalesce(F.size("_line"), F.lit(0)) < 2, DROP_REASONS[3])
        .when(F.exists("_line", lambda p: p.isNull() | (F.size(p) != 2)), DROP_REASONS[4])
        .when(F.col("current_speed").isNull(), DROP_REASONS[5])
    )
    extent = F.coalesce("extent", F.lit(4096))
    geometry = F.transform(
        "_line",
        lambda p: geo.tile_to_lonlat(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.col("x"), F.col("y"), F.col("zoom"), extent),
    )
    rest = [c for c in features.columns if c not in ("coordinates", "properties", "extent", "geom_type")]
    return (
        features.withColumn("_line", line)
        .withColumn("current_speed", current)
        .withColumn("drop_reason", reason)
        .withColumn("geometry", F.when(F.col("drop_reason").isNull(), geometry))
        .select(
            *rest,
            F.when(
                F.col("drop_reason").isNull(),
                observe.segment_id_from_props(F.col("properties"), F.col("layer"), F.col("geometry")),
            ).alias("segment_id"),
            "geometry",
            "current_speed",
            F.coalesce(
                observe.first_prop_double(F.col("properties"), observe.FREEFLOW_SPEED_KEYS), "current_speed"
            ).alias("freeflow_speed"),
            F.coalesce(
                observe.first_prop_double(F.col("properties"), observe.CONFIDENCE_KEYS),
                F.lit(observe.DEFAULT_CONFIDENCE),
            ).alias("quality"),
            "drop_reason",
        )
    )


def parse_flow_responses(responses: DataFrame) -> DataFrame:
    """Point-sample responses to segments; responses without coordinates are dropped."""
    data = F.col("flowSegmentData")
    points = data["coordinates"]["coordinate"]
    geometry = F.transform(points, lambda c: F.struct(c["longitude"].alias("lon"), c["latitude"].alias("lat")))
    current = F.coalesce(data["currentSpeed"], F.lit(0.0))
    rest = [c for c in responses.columns if c != "flowSegmentData"]
    first_point = F.xxhash64(points[0]["longitude"], points[0]["latitude"]).cast("string")
    return responses.where(F.size(points) > 0).select(
        *rest,
        F.concat(F.coalesce(data["frc"], F.lit("")), F.lit("_"), first_point).alias("segment_id"),
        geometry.alias("geometry"),
        current.alias("current_speed"),
        F.coalesce(data["freeFlowSpeed"], current).alias("freeflow_speed"),
        F.coalesce(data["confidence"], F.lit(observe.DEFAULT_CONFIDENCE)).alias("quality"),
        F.coalesce(data["frc"], F.lit("unknown")).alias("road_class"),
    )


def clip_to_bbox(segments: DataFrame, areas: DataFrame, keep_flag: bool = False) -> DataFrame:
    """Keep segments whose box meets the box of their area (or only flag them)."""
    box = F.struct("west", "south", "east", "north")
    joined = segments.join(areas.select("area_id", "west", "south", "east", "north"), "area_id")
    inside = F.coalesce(geo.bbox_intersects(geo.geometry_bbox(F.col("geometry")), box), F.lit(True))
    flagged = joined.withColumn("inside", inside).drop("west", "south", "east", "north")
    return flagged if keep_flag else flagged.where("inside").drop("inside")


def dedup_segments(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per segment id within ``keys``; rows without an id are all kept."""
    blank = F.coalesce(F.col("segment_id"), F.lit("")) == ""
    return first_by(segments.where(~blank), [*keys, "segment_id"], order).unionByName(segments.where(blank))


def dedup_by_first_point(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per first geometry point within ``keys``; rows without geometry are dropped."""
    pointed = segments.where(F.size("geometry") > 0).withColumn("_point", F.col("geometry")[0])
    return first_by(pointed, [*keys, "_point"], order).drop("_point")


def ingest_diagnostics(decoded: DataFrame, areas: DataFrame, order: list[str]) -> DataFrame:
    """Counts per area: features seen, dropped by reason, decoded, outside, duplicate, kept."""
    reasons = decoded.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("features_total"),
        *[F.count_if(F.col("drop_reason") == r).alias(r) for r in DROP_REASONS],
        F.count_if(F.col("drop_reason").isNull()).alias("segments_decoded"),
    )
    flagged = clip_to_bbox(decoded.where("drop_reason is null"), areas, keep_flag=True)
    blank = F.coalesce(F.col("segment_id"), F.lit("")) == ""
    # One row per id first, so that kept = distinct ids without a second pass over the data.
    per_id = flagged.groupBy("area_id", F.when(~blank, F.col("segment_id")).alias("id")).agg(
        F.count_if(~F.col("inside")).alias("outside"), F.count_if("inside").alias("inside")
    )
    kept = F.when(F.col("id").isNull(), F.col("inside")).otherwise(F.least(F.col("inside"), F.lit(1)))
    totals = per_id.groupBy("area_id").agg(
        F.sum("outside").alias("segments_dropped_outside_bbox"),
        F.sum(F.col("inside") - kept).alias("segments_dropped_duplicate_id"),
        F.sum(kept).alias("segments_kept"),
    )
    zero = F.lit(0).cast("bigint")
    return reasons.join(totals, "area_id", "left").select(
        "area_id", "features_total", *DROP_REASONS, "segments_decoded",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("segments_dropped_outside_bbox", "segments_dropped_duplicate_id", "segments_kept")
        ],
    )


def usable_snapshots(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """Whether any segment of a snapshot has a point inside the box of its area."""
    inside = F.coalesce(
        geo.has_point_in_bbox(F.col("geometry"), F.col("west"), F.col("south"), F.col("east"), F.col("north")),
        F.lit(False),
    )
    return (
        segments.join(areas.select("area_id", "west", "south", "east", "north"), "area_id")
        .groupBy("area_id", "snapshot_id")
        .agg(F.bool_or(inside).alias("usable"))
    )


def snapshot_timestamp(segments: DataFrame, meta: DataFrame, order: list[str]) -> DataFrame:
    """First parsable segment time in row order, else the creation time of the dataset."""
    parsed = segments.withColumn("_ts", F.try_to_timestamp(F.col("timestamp").cast("string")))
    first = parsed.where("_ts is not null").groupBy("area_id").agg(
        F.min_by("_ts", F.struct(*order)).alias("_first")
    )
    return meta.join(first, "area_id", "left").select(
        "area_id",
        F.coalesce("_first", F.try_to_timestamp(F.col("created_at").cast("string"))).alias("snapshot_ts"),
    )


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """``line`` to level and message; lines without a known level or a message are dropped."""
    rest = [c for c in lines.columns if c != "line"]
    return (
        lines.select(
            *rest, observe.log_level(F.col("line")).alias("level"), observe.log_message(F.col("line")).alias("message")
        )
        .where(F.col("level").isNotNull() & (F.col("message") != ""))
    )
