"""Structured Streaming forms: feeds, buckets, deduplication, matching, logs, progress, stagnation, quality."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from roadweave import schema as S
from roadweave.functions import observe, scoring
from roadweave.operators import cleaning, logs, matching, quality
from roadweave.session import pickle_by_value
from roadweave.sources.readers import explode_tiles, stream_log_lines

pickle_by_value(__name__)

BatchSink = Callable[[DataFrame, int], None]


def stream_segments(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed point-sample responses as a stream of segments; the batch parser does the work."""
    raw = (
        spark.readStream.schema(S.FLOW_RESPONSE + ", area_id string, timestamp timestamp")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    return cleaning.parse_flow_responses(raw)


def stream_tile_segments(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed decoded tiles as a stream of kept segments."""
    raw = spark.readStream.schema(S.TILE_FILE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return cleaning.decode_features(explode_tiles(raw)).where("drop_reason is null").drop("drop_reason")


def bucket_speeds(stream: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Last and mean speed and count per area, segment and tumbling bucket."""
    return (
        stream.withWatermark("timestamp", watermark)
        .groupBy("area_id", "segment_id", F.window("timestamp", width).alias("bucket"))
        .agg(
            F.max_by("current_speed", F.struct("timestamp", "current_speed")).alias("last_speed"),
            F.avg("current_speed").alias("mean_speed"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "area_id", "segment_id", F.col("bucket.start").alias("bucket_start"), "last_speed", "mean_speed", "n"
        )
    )


def dedup_stream(stream: DataFrame, watermark: str = "10 minutes", minutes: int = 5) -> DataFrame:
    """One record per segment and bucket; state is dropped after the watermark."""
    width = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("timestamp") / width) * width)
    return (
        stream.withColumn("bucket_start", start)
        .withWatermark("timestamp", watermark)
        .dropDuplicatesWithinWatermark(["area_id", "segment_id", "bucket_start"])
    )


def for_each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: BatchSink) -> DataStreamWriter:
    """Run a batch operator on every micro-batch and hand the result to ``sink``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(transform(batch), batch_id)

    return stream.writeStream.foreachBatch(handle)


def parquet_sink(path: str) -> BatchSink:
    """Replayed batches overwrite their own directory, so results are written exactly once."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_match(stream: DataFrame, edges: DataFrame, sink: BatchSink) -> DataStreamWriter:
    """Nearest-edge join of every micro-batch against the static network."""
    return for_each_batch(stream, lambda batch: matching.match_segments(batch, edges), sink)


def stream_quality(
    stream: DataFrame, edges: DataFrame, areas: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes",
    max_distance: float = 100.0, min_confidence: float = 0.1,
) -> DataFrame:
    """One quality score per area and tumbling bucket, emitted once the watermark has passed the end of the bucket.

    Rows may come in any number of triggers: the nearest edge of a segment, the counts and the histogram of confidences
    behind the exact median are mergeable aggregates of the state store, combined before the shuffle, so neither the number of
    triggers nor a busy area changes the plan. Rows without a timestamp and rows behind the watermark are left out.
    """
    bucket = F.window("timestamp", width).alias("bucket")
    # Equal rows of a bucket are one key of the first aggregation, with their number.
    keys = ["area_id", "segment_id", "_gkey"]
    rows = stream.withWatermark("timestamp", watermark).where("timestamp is not null").select(
        "timestamp", "area_id", "segment_id", "geometry", matching.geometry_key().alias("_gkey")
    )
    near = matching.candidate_edges(rows, edges, ["timestamp", *keys], max_distance, min_confidence)
    found = near.groupBy(*keys, bucket).agg(
        F.count_if("first").alias("n"), F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "edge_id"))).alias("hit")
    )
    near_enough = observe.match_confidence(F.col("hit.distance"), max_distance)
    confidence = F.when(near_enough >= min_confidence, near_enough)
    weighed = found.select("area_id", "bucket", "n", confidence.alias("conf"), F.when(confidence.isNotNull(), F.col("n")).alias("hits"))
    low = F.when(F.col("conf") < scoring.LOW_CONFIDENCE, F.col("n")).otherwise(0)
    figures = weighed.groupBy("area_id", "bucket").agg(
        F.sum("n").alias("fetched_segments"), F.coalesce(F.sum("hits"), F.lit(0)).alias("matched_edges"),
        (F.sum(low) / F.sum("hits")).alias("low_confidence_share"),
        F.expr("percentile(conf, 0.5D, coalesce(hits, 1))").alias("median_match_confidence"),
    )
    network = edges.groupBy("area_id").agg(F.count(F.lit(1)).alias("total_network_edges"))
    placed = figures.join(areas.join(network, "area_id", "left").fillna(0, ["total_network_edges"]), "area_id")
    return quality.score_quality(quality.quality_rates(placed.withColumn("bucket_start", F.col("bucket.start")).drop("bucket")))


class LogTail(StatefulProcessor):
    """Keeps the last ``n`` lines of one run, in the order of their files and offsets."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "age int, file string, block bigint, row bigint, level string, message string")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        columns = ["age", "file", "block", "row", "level", "message"]
        tail = [tuple(r) for r in self.lines.get()] if self.lines.exists() else []
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for frame in rows:
            seen += len(frame)
            # Never more than n lines are held beside the frame at hand.
            tail = heapq.nlargest(self.n, chain(tail, frame[columns].itertuples(index=False, name=None)), key=lambda r: r[:4])
        tail = [(int(a), f, int(b), int(r), level, message) for a, f, b, r, level, message in sorted(tail)]
        if tail:
            self.lines.put(tail)
            self.seen.update((int(seen),))
            yield pd.DataFrame(
                [(key[0], int(seen), place, r[4], r[5]) for place, r in enumerate(tail)],
                columns=["run_id", "seen", "place", "level", "message"],
            )

    def close(self) -> None:
        pass


def stream_logs(spark: SparkSession, path: str, n: int = 100, files_per_trigger: int = 1000) -> DataFrame:
    """The last ``n`` parsed lines of every run that got new ones, whatever trigger they came in; use update mode.

    ``seen`` counts the lines of the run so far and tells snapshots of a run apart (:func:`current_tails`). New files are
    picked up, not lines added to a known file, so writers must roll files. The order is that of ``read_pipeline_log``.
    Needs the RocksDB state store provider.
    """
    lines = stream_log_lines(spark, path, files_per_trigger)
    parsed = cleaning.parse_log_lines(lines).select("run_id", "line_no.*", "level", "message")
    return parsed.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=LogTail(n),
        outputStructType="run_id string, seen bigint, place bigint, level string, message string",
        outputMode="Update",
        timeMode="None",
    )


def current_tails(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each run among the stored ones."""
    newest = snapshots.groupBy("run_id").agg(F.max("seen").alias("seen"))
    return snapshots.join(newest, ["run_id", "seen"], "left_semi").select("run_id", "place", "level", "message").distinct()


def stream_progress(events: DataFrame) -> DataFrame:
    """Current stage and status per run; use update mode."""
    return logs.run_progress(events)


class StagnationDetector(StatefulProcessor):
    """Keeps the reference loss and the counter of one run; generations must arrive in order."""

    SLICE = 10_000

    def __init__(self, patience: int, epsilon: float):
        self.patience = patience
        self.epsilon = epsilon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stagnation", "reference double, stalled bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        reference, stalled = self.state.get() if self.state.exists() else (float("inf"), 0)
        # Two numbers are kept of each generation that finished since the last trigger; results leave in slices.
        finished = sorted(chain.from_iterable(zip(f["generation"].tolist(), f["best_loss"].tolist()) for f in rows))
        for start in range(0, len(finished), self.SLICE):
            out = []
            for generation, best in finished[start : start + self.SLICE]:
                out.append((key[0], int(generation), float(best), int(stalled), stalled >= self.patience))
                if best < reference - self.epsilon:
                    reference, stalled = best, 0
                else:
                    stalled += 1
            yield pd.DataFrame(out, columns=["run_id", "generation", "best_loss", "stalled", "boosted"])
        self.state.update((float(reference), int(stalled)))

    def close(self) -> None:
        pass


def stream_stagnation(stats: DataFrame, patience: int = 20, epsilon: float = 0.1) -> DataFrame:
    """Live stagnation flags. Needs the RocksDB state store provider."""
    return stats.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=StagnationDetector(patience, epsilon),
        outputStructType="run_id string, generation bigint, best_loss double, stalled bigint, boosted boolean",
        outputMode="Append",
        timeMode="None",
    )
