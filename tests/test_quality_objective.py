import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import objective, quality, reporting
from roadweave.operators.ordering import exact_median

# Published figures of five areas: box, segments, matched, edges, five scores, total, label.
GOLDENS = [
    ("a", (4.2817, 52.0696, 4.33, 52.0874), 49, 47, 1922, (35, 25, 15, 12, 8), 95, "excellent"),
    ("b", (20.0174, 50.0702, 20.0566, 50.0875), 44, 41, 1521, (35, 22, 15, 12, 8), 92, "excellent"),
    ("c", (-1.5717, 53.7964, -1.535, 53.811), 35, 32, 1709, (30, 22, 15, 12, 6), 85, "excellent"),
    ("d", (-1.69, 48.1054, -1.6576, 48.1189), 21, 20, 1004, (24, 25, 15, 8, 6), 78, "good"),
    ("e", (30.5011, 39.7613, 30.5229, 39.7727), 18, 18, 1588, (24, 25, 15, 12, 6), 82, "good"),
    ("none", (2.2961, 48.8469, 2.3071, 48.8532), 8, 0, 800, None, None, "poor"),
    ("good", (2.2961, 48.8469, 2.3071, 48.8532), 50, 45, 1200, None, None, None),
]


@pytest.fixture(scope="module")
def assessed(spark):
    areas = spark.createDataFrame([(g[0], *g[1]) for g in GOLDENS], "area_id string, west double, south double, east double, north double")

    def copies(n_index):
        rows = [(g[0], i) for g in GOLDENS for i in range(g[n_index])]
        return spark.createDataFrame(rows, "area_id string, i int")

    observed = copies(3).withColumn("match_confidence", F.when(F.col("area_id") == "good", 0.99).otherwise(1.0))
    return {r["area_id"]: r for r in quality.assess_quality(copies(2), observed, copies(4), areas).collect()}


@pytest.mark.parametrize("golden", [g for g in GOLDENS if g[5]], ids=lambda g: g[0])
def test_quality_goldens(assessed, golden):
    row = assessed[golden[0]]
    parts = tuple(row[c] for c in ("availability", "rate", "confidence", "density", "network_coverage"))
    assert (parts, row["score"], row["label"], row["recommendation"]) == (golden[5], golden[6], golden[7], "proceed")


def test_quality_without_matches(assessed):
    row = assessed["none"]
    assert (row["label"], row["recommendation"], row["match_rate"]) == ("poor", "do_not_proceed", 0.0)
    assert "no_matched_edges" in row["warnings"] and row["median_match_confidence"] is None


def test_quality_summary(assessed):
    row = assessed["good"]
    assert row["score"] >= 70 and row["label"] in ("good", "excellent") and row["recommendation"] == "proceed"
    assert row["summary"] == f"{row['label'].upper()} quality ({row['score']}/100): 45 matched edges from 50 traffic segments (match rate 90.0%)."


def test_exact_median_with_a_hot_group(spark):
    rnd = random.Random(5)
    rows = [("hot", 1.0)] * 900 + [("hot", rnd.random()) for _ in range(901)] + [("even", v) for v in (0.1, 0.9, 0.2, 0.8)]
    rows += [("wide", v) for v in (-7.0, 3.0, 9.0)] + [("gaps", None), ("gaps", float("nan")), ("gaps", 0.25)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in exact_median(df, ["k"], "v", "m", bins=16).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got["hot"] == hot[len(hot) // 2]
    assert got["even"] == 0.5 and got["wide"] == 3.0 and got["gaps"] == 0.25


OBSERVED = [("e1", 30, 50), ("e2", 50, 60), ("e3", 20, 50), ("e4", 60, 70), ("e5", 40, 50)]
SIMULATED = [("e1", 35), ("e2", 45), ("e3", 25), ("e5", 38)]


@pytest.fixture(scope="module")
def speeds(spark):
    observed = spark.createDataFrame(
        [("A", e, "s" + e, float(c), float(f)) for e, c, f in OBSERVED],
        "area_id string, edge_id string, segment_id string, current_speed double, freeflow_speed double",
    )
    simulated = spark.createDataFrame(
        [("A", "x", e, float(v)) for e, v in SIMULATED], "area_id string, scenario_id string, edge_id string, speed_kmh double"
    )
    scenarios = spark.createDataFrame([("A", "x"), ("A", "empty"), ("B", "nothing")], "area_id string, scenario_id string")
    return observed, simulated, scenarios


def trips(spark, routing=0, teleports=0):
    return spark.createDataFrame([("x", routing, teleports)], "scenario_id string, routing_failures bigint, teleports bigint")


def expected(spark, n=100):
    return spark.createDataFrame([("x", n)], "scenario_id string, expected_vehicles bigint")


def test_loss_components(spark, speeds):
    rows = {r["scenario_id"]: r for r in objective.loss_components(*speeds, trips(spark), expected(spark)).collect()}
    x = rows["x"]
    assert (x["mae"], x["coverage_penalty"], x["e_loss"], x["missing_edges"]) == (pytest.approx(5.4), 2.0, pytest.approx(7.4), 1)
    assert rows["empty"]["missing_edges"] == 5 and rows["empty"]["mae"] == pytest.approx(16.0)
    assert rows["nothing"]["loss"] == math.inf and rows["nothing"]["coverage_penalty"] == 0.0


def test_reliability_penalty_enters_the_loss(spark, speeds):
    rows = objective.loss_components(*speeds, trips(spark, 3, 2), expected(spark)).where("scenario_id = 'x'").collect()
    assert rows[0]["fail_total"] == 5 and rows[0]["reliability_penalty"] == 100.0 and rows[0]["loss"] == pytest.approx(107.4)


def test_speed_metrics_and_fit(speeds):
    m = objective.speed_metrics(*speeds).where("scenario_id = 'x'").first()
    assert (m["mse"], m["matched_edges"], m["avg_speed_diff"]) == (pytest.approx(35.8), 4, pytest.approx(2.6))
    f = objective.fit_stats(*speeds).where("scenario_id = 'x'").first()
    assert (f["r_squared"], f["rmse"], f["mae"]) == (pytest.approx(0.842), pytest.approx(4.444, abs=1e-3), pytest.approx(4.25))


def test_null_freeflow_poisons_only_scenarios_that_need_it(spark, speeds):
    observed, simulated, scenarios = speeds
    holed = observed.withColumn("freeflow_speed", F.when(F.col("edge_id") != "e1", F.col("freeflow_speed")))
    rows = {r["scenario_id"]: r["mae"] for r in objective.speed_metrics(holed, simulated, scenarios).collect()}
    assert rows["x"] == pytest.approx(5.4) and math.isnan(rows["empty"])


def test_freeflow_default_only_for_an_absent_column(speeds):
    observed, simulated, scenarios = speeds
    rows = {r["scenario_id"]: r for r in objective.speed_metrics(observed.drop("freeflow_speed"), simulated, scenarios).collect()}
    assert rows["empty"]["mae"] == pytest.approx(sum(abs(50 - c) for _, c, _ in OBSERVED) / 5)


def test_aggregates_equal_the_row_level_join(spark):
    rnd = random.Random(1)
    obs = [(a, f"e{i % 40}", f"s{i}", rnd.uniform(0, 90), rnd.uniform(0, 90)) for a in "AB" for i in range(60)]
    sim = [(a, f"{a}{s}", f"e{i}", rnd.uniform(0, 90)) for a in "AB" for s in range(5) for i in range(50) if rnd.random() < 0.5]
    observed = spark.createDataFrame(obs, "area_id string, edge_id string, segment_id string, current_speed double, freeflow_speed double")
    simulated = spark.createDataFrame(sim, "area_id string, scenario_id string, edge_id string, speed_kmh double")
    scenarios = spark.createDataFrame([(a, f"{a}{s}") for a in "AB" for s in range(6)], "area_id string, scenario_id string")
    got = {r["scenario_id"]: r for r in objective.speed_metrics(observed, simulated, scenarios).collect()}
    joined = objective.join_observed_simulated(observed, simulated, scenarios).groupBy("scenario_id").agg(
        F.avg(F.abs(F.col("effective_speed") - F.col("current_speed"))).alias("mae"), F.count_if("missing").alias("missing")
    )
    for r in joined.collect():
        assert got[r["scenario_id"]]["mae"] == pytest.approx(r["mae"])
        assert got[r["scenario_id"]]["missing_edges"] == r["missing"]


def test_comparison_and_mismatches(speeds):
    observed, simulated, scenarios = speeds
    only = scenarios.where("scenario_id = 'x'")
    lost = reporting.speed_comparison(observed, simulated, only).where("status = 'missing_in_sim'").collect()
    assert [r["edge_id"] for r in lost] == ["e4"] and lost[0]["simulated_speed"] is None
    worst = reporting.top_mismatches(observed, simulated, only, 1).first()
    assert (worst["edge_id"], worst["observed"], worst["simulated"], worst["error"], worst["note"]) == ("e4", 60.0, 0.0, 60.0, "(No Traffic)")


def test_missing_simulation_gives_the_sentinel(spark, speeds):
    observed, simulated, _ = speeds
    genomes = spark.createDataFrame([("A", "x", [1, 2, 3]), ("A", "lost", [4])], "area_id string, scenario_id string, genes array<int>")
    tripinfo = spark.createDataFrame([("x", "t1", 10.0, 2.0)], "scenario_id string, id string, duration double, waiting double")
    stats = spark.createDataFrame([("x", 6, 5, 1, 0, 1)], "scenario_id string, loaded bigint, inserted bigint, running bigint, waiting bigint, teleports bigint")
    rows = {r["scenario_id"]: r for r in objective.evaluate_scenarios(genomes, observed, simulated, tripinfo, stats).collect()}
    lost, x = rows["lost"], rows["x"]
    assert lost["worker_error"] and lost["loss"] == math.inf and lost["fail_total"] == 1 and lost["zero_flow_edges"] is None
    assert not x["worker_error"] and (x["routing_failures"], x["teleports"], x["total_vehicles"]) == (1, 1, 6)


def test_trip_stats_without_simulator_totals(spark):
    tripinfo = spark.createDataFrame([("x", "t", 10.0, 2.0), ("x", "u", 20.0, 4.0)], "scenario_id string, id string, duration double, waiting double")
    stats = spark.createDataFrame([("x", 0, 0, 9)], "scenario_id string, loaded bigint, inserted bigint, teleports bigint")
    want = spark.createDataFrame([("x", 5), ("y", 3)], "scenario_id string, expected_vehicles bigint")
    rows = {r["scenario_id"]: r for r in objective.trip_stats(tripinfo, stats, want).collect()}
    assert (rows["x"]["routing_failures"], rows["x"]["teleports"], rows["x"]["avg_duration"]) == (3, 0, 15.0)
    assert (rows["y"]["completed_trips"], rows["y"]["routing_failures"], rows["y"]["avg_duration"]) == (0, 3, 0.0)
