"""Run logs and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_logs(logs: DataFrame, n: int = 100) -> DataFrame:
    """Last ``n`` lines per run. The rank limit is applied before the shuffle, so a chatty run stays small."""
    latest = W.partitionBy("run_id").orderBy(F.desc("line_no"))
    return logs.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n).drop("_r")


def run_progress(events: DataFrame) -> DataFrame:
    """Current stage, stage name and status per run: those of the latest event."""
    return events.groupBy("run_id").agg(
        F.max_by("stage", "event_no").alias("stage"),
        F.max_by("stage_name", "event_no").alias("stage_name"),
        F.max_by("status", "event_no").alias("status"),
    )
