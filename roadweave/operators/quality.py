"""Data quality per area and the dataset manifest built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions import geo, scoring
from roadweave.operators.ordering import exact_median


def quality_inputs(segments: DataFrame, observed: DataFrame, edges: DataFrame, areas: DataFrame) -> DataFrame:
    """Counts, rates and confidence figures per area."""
    conf = F.col("match_confidence").cast("string").try_cast("double")
    numeric = observed.select("area_id", F.when(~F.isnan(conf), conf).alias("conf"))
    fetched = segments.groupBy("area_id").agg(F.count(F.lit(1)).alias("fetched_segments"))
    matched = numeric.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("matched_edges"),
        F.avg((F.col("conf") < scoring.LOW_CONFIDENCE).cast("double")).alias("low_confidence_share"),
    )
    median = exact_median(numeric, ["area_id"], "conf", "median_match_confidence")
    network = edges.groupBy("area_id").agg(F.count(F.lit(1)).alias("total_network_edges"))
    joined = areas
    for part in (fetched, matched, median, network):
        joined = joined.join(part, "area_id", "left")
    return quality_rates(joined.fillna(0, ["fetched_segments", "matched_edges", "total_network_edges"]))


def quality_rates(joined: DataFrame) -> DataFrame:
    """Rates and densities from the counts and the box of an area."""
    area = geo.bbox_area_km2(F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    n = F.col("matched_edges")
    return (
        joined.withColumn("area_km2", area)
        .withColumn(
            "match_rate",
            F.when(F.col("fetched_segments") > 0, n / F.col("fetched_segments")).otherwise(0.0),
        )
        .withColumn(
            "observed_to_total_ratio",
            F.when(F.col("total_network_edges") > 0, n / F.col("total_network_edges")),
        )
        .withColumn("edges_per_km2", F.when(F.col("area_km2") > 0, n / F.col("area_km2")))
    )


def score_quality(inputs: DataFrame) -> DataFrame:
    """Score, label, recommendation, warnings and summary from the per-area figures."""
    c = F.col
    scored = (
        inputs.withColumn("availability", scoring.matched_score(c("matched_edges")))
        .withColumn("rate", scoring.match_rate_score(c("match_rate")))
        .withColumn("confidence", scoring.confidence_score(c("median_match_confidence"), c("low_confidence_share")))
        .withColumn("density", scoring.density_score(c("edges_per_km2")))
        .withColumn("network_coverage", scoring.coverage_score(c("observed_to_total_ratio")))
        .withColumn(
            "score", c("availability") + c("rate") + c("confidence") + c("density") + c("network_coverage")
        )
        .withColumn("label", scoring.quality_label(c("score")))
        .withColumn("recommendation", scoring.recommendation(c("score"), c("matched_edges")))
        .withColumn(
            "warnings",
            scoring.quality_warnings(
                c("fetched_segments"), c("matched_edges"), c("match_rate"), c("edges_per_km2"),
                c("observed_to_total_ratio"), c("median_match_confidence"),
            ),
        )
    )
    summary = F.concat(
        F.upper("label"), F.lit(" quality ("), c("score").cast("string"), F.lit("/100): "),
        c("matched_edges").cast("string"), F.lit(" matched edges from "), c("fetched_segments").cast("string"),
        F.lit(" traffic segments (match rate "), F.bround(c("match_rate") * 100, 1).cast("string"), F.lit("%)."),
    )
    return scored.withColumn("summary", summary)


def assess_quality(segments: DataFrame, observed: DataFrame, edges: DataFrame, areas: DataFrame) -> DataFrame:
    return score_quality(quality_inputs(segments, observed, edges, areas))


def dataset_manifest(quality: DataFrame, meta: DataFrame) -> DataFrame:
    """Nested bundle record. ``meta``: area_id, dataset_name, created_at, traffic_tile_zoom, provider."""
    c = F.col
    # Places of the bundle files.
    files = {
        "traffic_data_raw_csv": "data/traffic_data_raw.csv",
        "observed_edges_csv": "data/observed_edges.csv",
        "osm_file": "data/map.osm",
        "sumo_network": "sumo/network.net.xml",
        "network_plot": "plots/network.png",
        "pipeline_log": "logs/pipeline.log",
    }
    return quality.join(meta, "area_id").select(
        "area_id",
        "dataset_name",
        "created_at",
        F.struct("west", "south", "east", "north").alias("bbox"),
        "traffic_tile_zoom",
        "provider",
        F.struct("fetched_segments", "matched_edges", "total_network_edges").alias("stats"),
        F.struct(
            "score", "label", "recommendation", "summary", "warnings",
            F.struct(
                "availability", c("rate").alias("match_rate"), "confidence", "density", "network_coverage"
            ).alias("components"),
            F.struct(
                "fetched_segments", "matched_edges", "total_network_edges", "match_rate",
                "observed_to_total_ratio", "area_km2", "edges_per_km2",
                "median_match_confidence", "low_confidence_share",
            ).alias("metrics"),
        ).alias("quality"),
        F.create_map(*[F.lit(v) for pair in files.items() for v in pair]).alias("files"),
    )


def gate(quality: DataFrame, min_score: int = 0, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Areas that may go on: something matched, score high enough, recommendation accepted."""
    passed = quality.where((F.col("matched_edges") > 0) & (F.col("score") >= min_score))
    if allowed is not None:
        passed = passed.where(F.col("recommendation").isin(*allowed))
    return passed.select("area_id")
