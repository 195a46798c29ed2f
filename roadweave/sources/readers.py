"""Readers for landed files. Partition directories such as ``area_id=..`` or ``scenario_id=..`` become columns.

Where areas or scenarios are many and small, a file may hold several of them: ``key`` then names the attribute or last column that
says which one a row belongs to, and no directory has to be made and listed for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave import schema as S
from roadweave.functions import geo, observe
from roadweave.operators.matching import INTERNAL


def _xml(spark: SparkSession, path: str, row_tag: str, schema, key: str | None = None) -> DataFrame:
    raw = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("mode", "DROPMALFORMED")
        .option("ignoreNamespace", "true")
        .schema(schema if key is None else f"{schema}, _{key} string")
        .load(path)
    )
    return raw if key is None else raw.withColumnRenamed(f"_{key}", key)


def _extra(df: DataFrame, schema) -> list[str]:
    """Columns that come from partition directories."""
    return [c for c in df.columns if c not in S.struct(schema).fieldNames()]


def parse_geometry_text(text):
    """``[(lon, lat), ...]`` as text to an array of points."""
    pairs = F.from_json(F.translate(text, "()", "[]"), "array<array<double>>")
    return F.transform(pairs, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def _with_key(schema: str, key: str | None) -> str:
    return schema if key is None else f"{schema}, {key} string"


def read_traffic_csv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    raw = spark.read.schema(_with_key(S.TRAFFIC_CSV, key)).option("header", True).option("escape", '"').csv(path)
    return raw.withColumn("geometry", parse_geometry_text(F.col("geometry")))


def read_observed_csv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    return spark.read.schema(_with_key(S.OBSERVED_EDGES, key)).option("header", True).csv(path)


def read_net_lanes(spark: SparkSession, path: str) -> DataFrame:
    """One row per lane of every public edge; ``lane_pos`` is the position in the file."""
    raw = _xml(spark, path, "edge", S.NET_EDGE_XML)
    extra = _extra(raw, S.NET_EDGE_XML)
    lanes = raw.where(F.col("_id").isNotNull() & (F.col("_id") != "") & ~F.col("_id").startswith(INTERNAL)).select(
        *extra, "_id", "_priority", "_type", F.posexplode("lane").alias("lane_pos", "l")
    )
    return lanes.select(
        *extra,
        F.col("_id").alias("edge_id"),
        F.coalesce(F.col("_priority").try_cast("int"), F.lit(-1)).alias("priority"),
        F.coalesce("_type", F.lit("")).alias("type"),
        "lane_pos",
        F.coalesce("l._index", F.lit("0")).try_cast("int").alias("lane_index"),
        F.col("l._allow").alias("allow"),
        F.col("l._disallow").alias("disallow"),
        F.coalesce(F.col("l._speed").try_cast("double"), F.lit(observe.DEFAULT_LANE_SPEED)).alias("speed"),
        F.col("l._shape").alias("shape"),
    )


def read_net_connections(spark: SparkSession, path: str) -> DataFrame:
    raw = _xml(spark, path, "connection", S.NET_CONNECTION_XML)
    return raw.select(
        *_extra(raw, S.NET_CONNECTION_XML),
        F.col("_from").alias("from_edge"),
        F.col("_to").alias("to_edge"),
        F.coalesce("_fromLane", F.lit("0")).try_cast("int").alias("from_lane"),
        F.coalesce("_toLane", F.lit("0")).try_cast("int").alias("to_lane"),
    )


def read_net_location(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    raw = _xml(spark, path, "location", S.NET_LOCATION_XML, key)
    parts = F.transform(F.split("_netOffset", ","), lambda p: F.trim(p).try_cast("double"))
    good = (F.size(parts) == 2) & ~F.exists(parts, lambda p: p.isNull())
    return raw.select(
        *_extra(raw, S.NET_LOCATION_XML),
        F.col("_projParameter").alias("proj"),
        F.when(good, F.get(parts, F.lit(0))).otherwise(0.0).alias("x_off"),
        F.when(good, F.get(parts, F.lit(1))).otherwise(0.0).alias("y_off"),
    )


def read_edge_intervals(spark: SparkSession, path: str) -> DataFrame:
    raw = _xml(spark, path, "interval", S.INTERVAL_XML)
    extra = _extra(raw, S.INTERVAL_XML)
    return raw.select(
        *extra,
        F.coalesce(F.col("_begin").try_cast("double"), F.lit(0.0)).alias("begin"),
        F.coalesce(F.col("_end").try_cast("double"), F.lit(0.0)).alias("end"),
        F.explode_outer("edge").alias("e"),
    ).select(*extra, "begin", "end", F.col("e._id").alias("edge_id"), F.col("e._speed").alias("speed"))


def read_tripinfo(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    raw = _xml(spark, path, "tripinfo", S.TRIPINFO_XML, key)
    return raw.select(
        *_extra(raw, S.TRIPINFO_XML),
        F.col("_id").alias("id"),
        observe.safe_double(F.col("_duration")).alias("duration"),
        observe.safe_double(F.col("_waitingTime")).alias("waiting"),
    )


def read_sim_statistics(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Vehicle counts; teleports from their own element if present, else from the older attribute, else 0."""
    raw = _xml(spark, path, "statistics", S.STATISTICS_XML, key)
    vehicles = {k: observe.safe_int(F.col(f"vehicles._{k}")).alias(k) for k in ("loaded", "inserted", "running", "waiting")}
    own = F.when(F.col("teleports").isNotNull(), observe.safe_int(F.col("teleports._total")))
    return raw.select(
        *_extra(raw, S.STATISTICS_XML),
        *vehicles.values(),
        F.coalesce(own, observe.safe_int(F.col("vehicles._teleports"))).alias("teleports"),
    )


def read_trips(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Trips given as ``trip`` elements or as vehicles with a route; rows without both ends are dropped."""
    trips = _xml(spark, path, "trip", S.TRIP_XML, key)
    extra = _extra(trips, S.TRIP_XML)
    vehicles = _xml(spark, path, "vehicle", S.VEHICLE_XML, key)
    stops = F.filter(F.split(F.trim("route._edges"), r"\s+"), lambda s: s != "")
    depart = observe.safe_double(F.col("_depart")).alias("departure")
    plain = trips.select(
        *extra, F.col("_id").alias("trip_id"), depart, F.col("_from").alias("origin"), F.col("_to").alias("destination")
    )
    routed = vehicles.select(
        *extra, F.col("_id").alias("trip_id"), depart,
        F.try_element_at(stops, F.lit(1)).alias("origin"), F.try_element_at(stops, F.lit(-1)).alias("destination"),
    )
    both = plain.unionByName(routed)
    return both.where("origin is not null and destination is not null and origin <> '' and destination <> ''")


def read_flow_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.FLOW_RESPONSE).json(path).where("flowSegmentData is not null")


def explode_tiles(tiles: DataFrame) -> DataFrame:
    """Decoded tiles (x, y, zoom, layers) to one row per feature."""
    layers = tiles.select("*", F.explode("layers").alias("layer", "_l")).drop("layers")
    features = layers.select("*", F.posexplode("_l.features").alias("feature_idx", "_f"))
    geom = F.col("_f.geometry")
    kind = geom["type"]
    single = F.from_json(geom["coordinates"], "array<array<double>>")
    several = F.from_json(geom["coordinates"], "array<array<array<double>>>")
    keep = [c for c in tiles.columns if c != "layers"]
    return features.select(
        *keep,
        "layer",
        F.coalesce("_l.extent", F.lit(4096)).alias("extent"),
        "feature_idx",
        kind.alias("geom_type"),
        F.when(kind == "LineString", F.array(single)).when(kind == "MultiLineString", several).alias("coordinates"),
        F.coalesce("_f.properties", F.create_map().cast("map<string,string>")).alias("properties"),
    )


def read_tile_features(spark: SparkSession, path: str) -> DataFrame:
    return explode_tiles(spark.read.schema(S.TILE_FILE).json(path))


def scan_dataset_catalog(
    spark: SparkSession, root: str, source: str, pattern: str = "*/dataset_meta.json", key: str | None = None
) -> DataFrame:
    """Every readable metadata file ``<root>/<name>/dataset_meta.json`` with a valid box.

    With ``key`` a file holds a line for each of many datasets, and this field names them.
    """
    read = spark.read.schema(_with_key(S.DATASET_META, key)).option("mode", "DROPMALFORMED").option("multiLine", key is None)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]+$", 1) if key is None else F.col(key)
    meta = read.json(f"{root}/{pattern}").withColumn("name", name)
    box = [F.col(f"bbox.{side}") for side in ("west", "south", "east", "north")]
    return meta.where(geo.valid_bbox(*box)["ok"]).select(
        F.concat(F.lit(f"{source}:"), "name").alias("id"),
        "name",
        F.lit(source).alias("source"),
        *[b.alias(n) for b, n in zip(box, ("west", "south", "east", "north"))],
        "created_at",
        F.col("quality.label").alias("quality_label"),
        F.col("quality.score").alias("quality_score"),
        "provider", "stats", "files",
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file below ``root``; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """Ids of all ``run_<id>`` directories below ``root``."""
    run_id = F.regexp_extract("path", r"[/=]run_([^/]+)/", 1)
    return list_files(spark, root).select(run_id.alias("run_id")).where("run_id <> ''").distinct()


def line_position(row: Column) -> Column:
    """Sortable place of a log line among the lines of its run; ``row`` numbers the lines of a file block.

    A rolled file (``name.1``, ``name.2`` ...) is older the larger its number, so it comes before the file that is written.
    """
    rolled = F.regexp_extract(F.col("_metadata.file_path"), r"\.([0-9]+)$", 1)
    age = F.when(rolled == "", 0).otherwise(rolled.cast("int"))
    return F.struct(
        (-age).alias("age"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), row.cast("bigint").alias("row"),
    )


def _run_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"[/=]run_([^/]+)/", 1).alias("run_id")


def read_pipeline_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their run and a sortable position; parse them with ``parse_log_lines``."""
    position = line_position(F.monotonically_increasing_id()).alias("line_no")
    return spark.read.text(path).select(_run_of_file(), position, F.col("value").alias("line"))


def stream_log_lines(spark: SparkSession, path: str, files_per_trigger: int) -> DataFrame:
    """The same columns from new files below ``path``, as a stream. A file is one row until its lines are numbered."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True, recursiveFileLookup=True)
    lines = files.select("_metadata", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("_row", "line"))
    return lines.select(_run_of_file(), line_position(F.col("_row")).alias("line_no"), "line")
