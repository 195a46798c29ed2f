"""Session settings and the shared folder that iterative operators write to."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "roadweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume: UTC, AQE, skew-join handling."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Several operators multiply rows after a shuffle: keep small shuffles spread over all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a folder below the warehouse takes its place; on a cluster that is an error, because
    the warehouse may be a folder of one machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_roadweave"
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df``; the shuffle files behind it go as soon as it is written, not when the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.set(CLEANUP_CONF, before) if before is not None else conf.unset(CLEANUP_CONF)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, survives executor loss, known size.

    The real file size lets the planner broadcast a small result and shuffle a large one.
    """
    path = scratch_path(df.sparkSession, "cut")
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, wherever Spark can reach it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Named intermediate tables of one job in the shared folder.

    A table that is stored under a known name takes the place of the one before, which is deleted once the new one is
    written; ``drop`` deletes what no later step reads. Only what the result still reads is left at the end.
    """

    def __init__(self, spark: SparkSession, label: str = "scratch"):
        self.spark, self.label = spark, label
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        _write(df, path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            delete_path(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete_path(self.spark, path)


def pickle_by_value(module_name: str) -> None:
    """Send the Python functions of a module to workers as code, so that workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
