import json
from datetime import datetime, timedelta

import pytest

from roadweave.operators import cleaning
from roadweave.sources.readers import read_pipeline_log
from roadweave.streaming import streams

SEGMENT = "area_id string, segment_id string, timestamp timestamp, current_speed double"
START = datetime(2026, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(stream, tmp_path, mode="append", **sink):
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode(mode)
    writer.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def landed(spark, tmp_path, batches, ddl):
    """Every batch becomes one file; the stream takes one file per trigger, in order of writing."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "part=*"))


def test_buckets_and_late_rows(spark, tmp_path):
    batches = [
        [("A", "s", at(1), 10.0), ("A", "s", at(4), 30.0), ("A", "s", at(6), 50.0)],
        [("A", "s", at(40), 1.0)],
        [("A", "s", at(41), 3.0)],
        [("A", "s", at(2), 999.0)],  # behind the watermark of the batch before
        [("A", "s", at(90), 1.0)],
    ]
    out = run(streams.bucket_speeds(landed(spark, tmp_path, batches, SEGMENT)), tmp_path)
    rows = sorted((r["bucket_start"], r["last_speed"], r["mean_speed"], r["n"]) for r in out.collect())
    assert rows == [(at(0), 30.0, 20.0, 2), (at(5), 50.0, 50.0, 1), (at(40), 3.0, 2.0, 2)]


def test_one_record_per_bucket_across_batches(spark, tmp_path):
    batches = [[("A", "s", at(1), 10.0)], [("A", "s", at(3), 20.0), ("A", "s", at(6), 1.0), ("A", "t", at(3), 2.0)], [("A", "s", at(4), 5.0)]]
    out = run(streams.dedup_stream(landed(spark, tmp_path, batches, SEGMENT)), tmp_path)
    assert sorted((r["segment_id"], r["bucket_start"]) for r in out.collect()) == [("s", at(0)), ("s", at(5)), ("t", at(0))]


def test_landed_responses(spark, tmp_path):
    body = {"frc": "FRC2", "currentSpeed": 31, "coordinates": {"coordinate": [{"latitude": 50.0, "longitude": 20.0}, {"latitude": 50.1, "longitude": 20.1}]}}
    (tmp_path / "in").mkdir()
    lines = [{"flowSegmentData": body, "area_id": "A"}, {"flowSegmentData": {"frc": "x", "coordinates": {"coordinate": []}}}, {"error": 1}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    rows = run(streams.stream_segments(spark, str(tmp_path / "in")), tmp_path).collect()
    assert len(rows) == 1 and rows[0]["segment_id"].startswith("FRC2_")
    assert (rows[0]["freeflow_speed"], rows[0]["quality"], rows[0]["road_class"], rows[0]["geometry"][1]["lon"]) == (31.0, 0.9, "FRC2", 20.1)


def test_stagnation_across_batches(spark, tmp_path):
    losses = [10, 9, 9, 9, 9, 8.95, 8, 8, 8, 8, 8]
    rows = [("r", i, float(v)) for i, v in enumerate(losses)]
    batches = [rows[:2], rows[2:7], rows[7:]]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = landed(spark, tmp_path, batches, "run_id string, generation bigint, best_loss double")
        out = run(streams.stream_stagnation(stream, patience=3), tmp_path)
        got = [(r["stalled"], r["boosted"]) for r in out.orderBy("generation").collect()]
    finally:
        spark.conf.set(key, before)
    reference, counter, want = float("inf"), 0, []
    for v in losses:
        want.append((counter, counter >= 3))
        reference, counter = (v, 0) if v < reference - 0.1 else (reference, counter + 1)
    assert got == want


def test_matching_sink_replays_into_the_same_place(spark, tmp_path):
    geometry = "array<struct<x:double,y:double>>"
    edges = spark.createDataFrame([("A", "e", [(0.0, 0.0), (100.0, 0.0)])], f"area_id string, edge_id string, geometry {geometry}")
    batches = [[("A", "near", [(0.0, 10.0), (9.0, 10.0)])], [("A", "far", [(0.0, 500.0), (9.0, 500.0)]), ("A", "on", [(5.0, -5.0), (5.0, 5.0)])]]
    stream = landed(spark, tmp_path, batches, f"area_id string, segment_id string, geometry {geometry}")
    sink = streams.parquet_sink(str(tmp_path / "out"))
    query = streams.stream_match(stream, edges, sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {r["segment_id"]: r["match_confidence"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"near": pytest.approx(0.9), "on": 1.0}
    sink(spark.range(0).selectExpr("'A' as area_id", "'e' as edge_id", "'x' as segment_id", "1d as match_confidence"), 1)
    assert [r["segment_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["near"]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def quality_rows(spark, folder, batches):
    point = "array<struct<x:double,y:double>>"
    edges = spark.createDataFrame(
        [("A", "e1", [(0.0, 0.0), (100.0, 0.0)]), ("A", "e2", [(0.0, 500.0), (100.0, 500.0)])], f"area_id string, edge_id string, geometry {point}"
    )
    areas = spark.createDataFrame([("A", 10.0, 50.0, 10.02, 50.02)], "area_id string, west double, south double, east double, north double")
    stream = landed(spark, folder, batches, f"area_id string, segment_id string, timestamp timestamp, geometry {point}")
    out = run(streams.stream_quality(stream, edges, areas), folder)
    columns = ["bucket_start", "fetched_segments", "matched_edges", "total_network_edges", "median_match_confidence", "low_confidence_share", "score", "label"]
    return sorted(tuple(r) for r in out.select(*columns).collect())


def test_quality_of_a_bucket_does_not_depend_on_the_triggers(spark, tmp_path):
    def line(y):
        return [(10.0, y), (60.0, y)]

    rows = [
        ("A", "s1", at(1), line(10.0)), ("A", "s2", at(2), line(40.0)), ("A", "s2", at(3), line(40.0)), ("A", "s3", at(4), line(250.0)),
        ("A", "point", at(4), [(1.0, 1.0)]), ("A", "none", at(4), None), ("A", "s4", at(6), line(510.0)), ("A", None, at(7), line(95.0)),
    ]
    end = [("A", "late", at(60), line(0.0))]
    one = quality_rows(spark, tmp_path / "one", [rows + end, end])
    three = quality_rows(spark, tmp_path / "three", [rows[::3], rows[1::3], rows[2::3], end, end])
    assert one == three
    # Two equal segments of a bucket count twice, also in the median; one beyond the reach of 0.1 counts as fetched only.
    assert [r[:4] for r in one] == [(at(0), 6, 3, 2), (at(5), 2, 1, 2)]
    assert one[0][4] == pytest.approx(0.6) and one[0][5] == pytest.approx(2 / 3) and one[1][4] == pytest.approx(0.9)


def test_log_tail_keeps_the_last_lines_of_a_run(spark, tmp_path, rocksdb):
    def write(name, run_id, numbers):
        folder = tmp_path / "logs" / f"run_{run_id}"
        folder.mkdir(parents=True, exist_ok=True)
        lines = [f"2026-01-01 00:00:00 - app - {'DEBUG' if n % 5 == 4 else 'INFO'} - line {n}" for n in numbers]
        (folder / name).write_text("\n".join(lines) + "\n")

    def consume():
        tails = streams.stream_logs(spark, str(tmp_path / "logs"), n=6, files_per_trigger=1)
        sink = streams.parquet_sink(str(tmp_path / "out"))
        writer = streams.for_each_batch(tails, lambda b: b, sink).outputMode("update")
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        found = streams.current_tails(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
        out = {}
        for r in found.orderBy("run_id", "place").collect():
            out.setdefault(r["run_id"], []).append(int(r["message"].split()[-1]))
        return out

    write("app.log.2", "a", range(10))
    write("app.log.1", "a", range(10, 14))
    write("app.log", "b", range(3))
    assert consume() == {"a": [7, 8, 10, 11, 12, 13], "b": [0, 1, 2]}
    # The file in use is newer than the rolled ones, whatever trigger brings it; the other run keeps its tail.
    write("app.log", "a", range(14, 17))
    assert consume() == {"a": [10, 11, 12, 13, 15, 16], "b": [0, 1, 2]}
    batch = cleaning.parse_log_lines(read_pipeline_log(spark, str(tmp_path / "logs" / "*"))).where("run_id = 'a'")
    latest = [int(r["message"].split()[-1]) for r in batch.orderBy("line_no").collect()][-6:]
    assert latest == consume()["a"] == [10, 11, 12, 13, 15, 16]
