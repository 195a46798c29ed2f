"""Keyed results, storage inventory and bundle checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Files every dataset bundle must hold.
REQUIRED_FILES = (
    "data/traffic_data_raw.csv",
    "data/observed_edges.csv",
    "sumo/network.net.xml",
    "dataset_meta.json",
)


def holds_results(spark: SparkSession, root: str) -> bool:
    """Whether a write to ``root`` has been completed; any other fault of a stored result stays an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def materialize(inputs: DataFrame, build: Callable[[DataFrame], DataFrame], root: str, key: str = "cache_key") -> DataFrame:
    """Results of ``build`` for every key of ``inputs``; keys already stored under ``root`` are not built again.

    Results are parquet partitions named by their content key. A key that yields no rows is not stored.
    """
    spark = inputs.sparkSession
    missing = inputs
    if holds_results(spark, root):
        stored = spark.read.parquet(root).select(F.col(key).cast("string").alias(key)).distinct()
        missing = inputs.join(stored, key, "left_anti")
    built = build(missing)
    # The rows of a key meet before the write, or every task would write a file for each of its keys; a large key is split.
    built.hint("rebalance", key).write.mode("append").partitionBy(key).parquet(root)
    result = spark.read.schema(built.schema).parquet(root).select(*built.columns)
    return result.join(inputs.select(key).distinct(), key, "left_semi")


def storage_stats(files: DataFrame) -> DataFrame:
    """Per category (parent folder) the number of files and MB; sidecars count as bytes, not as files."""
    category = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.groupBy(category.alias("category")).agg(
        F.count_if(~F.col("path").endswith(".meta.json")).alias("files"),
        (F.sum("length") / (1024 * 1024)).alias("size_mb"),
    )


def bundle_completeness(files: DataFrame) -> DataFrame:
    """``files``: dataset, rel_path. Missing required files per dataset as one sorted text."""
    names = files.select("dataset").distinct()
    wanted = names.select("dataset", F.explode(F.array(*map(F.lit, REQUIRED_FILES))).alias("rel_path"))
    # At most as many rows per dataset as there are required files.
    missing = wanted.join(files, ["dataset", "rel_path"], "left_anti").groupBy("dataset").agg(
        F.array_sort(F.collect_list("rel_path")).alias("missing")
    )
    return names.join(missing, "dataset", "left").select(
        "dataset",
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        F.col("missing").isNull().alias("complete"),
    )
