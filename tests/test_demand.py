import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import demand
from roadweave.operators.ordering import explode_range, number_rows, number_rows_sliced, running_min, running_sum

PAIRS = [("A", 0, "A", "B"), ("A", 1, "C", "D")]
BINS = [("A", 0, 0, 60), ("A", 1, 60, 120)]


def trips_of(spark, values, style="trip", chunk=4096):
    genes = spark.createDataFrame(
        [("s", "A", i // 2, i % 2, v) for i, v in enumerate(values)], "scenario_id string, area_id string, od_idx int, bin_idx int, value int"
    )
    pairs = spark.createDataFrame(PAIRS, "area_id string, od_idx int, origin string, destination string")
    bins = spark.createDataFrame(BINS, "area_id string, bin_idx int, start_s int, end_s int")
    return demand.expand_trips(genes, pairs, bins, 2, style, chunk)


def test_expansion(spark):
    rows = {r["trip_id"]: (r["departure"], r["origin"], r["destination"]) for r in trips_of(spark, [1, 0, 2, 1]).collect()}
    assert rows == {"trip_0": (60, "A", "B"), "trip_1": (30, "C", "D"), "trip_2": (60, "C", "D"), "trip_3": (120, "C", "D")}
    ids = {r["trip_id"] for r in trips_of(spark, [1, 0, 2, 1], "t").collect()}
    assert ids == {"t_0_0_0", "t_1_0_1", "t_1_0_2", "t_1_1_3"}


def test_large_counts_are_cut_into_chunks(spark):
    whole, cut = trips_of(spark, [1000, 0, 7, 333]), trips_of(spark, [1000, 0, 7, 333], chunk=64)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    assert whole.count() == 1340 == whole.select("trip_id").distinct().count()


def test_trip_order_compares_ids_as_text(spark):
    rows = [("s", f"trip_{i}", "a", "b", 5.0) for i in (2, 10, 1)] + [("s", "trip_9", "a", "b", 1.0)]
    ordered = demand.order_trips(spark.createDataFrame(rows, "scenario_id string, trip_id string, origin string, destination string, departure double"))
    assert [r["trip_id"] for r in ordered.collect()] == ["trip_9", "trip_1", "trip_10", "trip_2"]


@pytest.mark.parametrize(
    ("warmup", "window", "width", "n", "last"),
    [(5, 15, 5, 4, (900, 1200)), (5, 15, 7, 3, (840, 1200)), (0, 1, 0.001, 60, (59, 60)), (0, 0, 5, 1, (0, 0)), (0, 5, 2, 2, (120, 300))],
)
def test_departure_bins(spark, warmup, window, width, n, last):
    areas = spark.createDataFrame([("A", float(warmup), float(window), float(width))], "area_id string, warmup_minutes double, window_minutes double, bin_minutes double")
    rows = demand.departure_bins(areas).orderBy("bin_idx").collect()
    assert len(rows) == n and (rows[-1]["start_s"], rows[-1]["end_s"]) == last


def test_genome_round_trip_and_size_check(spark):
    genomes = spark.createDataFrame([("s", [1, 2, 3, 4, 5, 6])], "scenario_id string, genes array<int>")
    long = demand.explode_genome(genomes, 2)
    assert [(r["od_idx"], r["bin_idx"], r["value"]) for r in long.orderBy("gene_idx").collect()][3] == (1, 1, 4)
    back = demand.collapse_genome(long, 3, 2).first()
    assert back["genes"] == [1, 2, 3, 4, 5, 6] and back["complete"]
    assert not demand.collapse_genome(long.where("gene_idx <> 2"), 3, 2).first()["complete"]


@pytest.mark.parametrize(("vehicles", "size", "upper", "p"), [(1000, 200, 10, None), (100, 200, 1, None), (300, 200, 3, None), (260, 200, 2, None), (180, 200, 1, None), (40, 200, 1, 0.4), (10, 200, 1, 0.1), (0, 10, 1, 0.001)])
def test_init_bounds(spark, vehicles, size, upper, p):
    row = demand.init_bounds(spark.createDataFrame([("A", vehicles, size)], "area_id string, initial_population int, genome_size int")).first()
    assert row["upper_bound"] == upper
    assert row["activation"] is None if p is None else row["activation"] == pytest.approx(p)


def test_agents_and_dictionary(spark):
    trips = spark.createDataFrame(
        [("r", "t1", "e9", "e2", 12.9), ("r", "t2", "e10", "e2", 3.0), ("q", "t3", "z", "y", 0.0)],
        "run_id string, trip_id string, origin string, destination string, departure double",
    )
    agents = {r["id"]: (r["origin"], r["destination"], r["start_time"], r["kind"]) for r in demand.index_agents(trips).collect()}
    assert agents == {"t1": (1, 0, 12, "Human"), "t2": (0, 0, 3, "Human"), "t3": (0, 0, 0, "Human")}
    listed = demand.od_dictionary(trips).where("run_id = 'r' and role = 'origins'").orderBy("idx").collect()
    assert [r["edge_id"] for r in listed] == ["e10", "e9"]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, many of them with equal values."""
    rnd = random.Random(8)
    rows = [("hot", rnd.choice([0.0, 1.0, rnd.random(), float("inf")]), i) for i in range(3000)]
    rows += [(f"k{i % 20}", rnd.random(), i) for i in range(500)]
    return rows, spark.createDataFrame(rows, "k string, v double, i int").repartition(7)


def test_sliced_numbering_equals_a_window(skewed):
    rows, df = skewed
    want, seen = {}, {}
    for k, v, i in sorted(rows):
        want[k, i] = seen.get(k, 0)
        seen[k] = want[k, i] + 1
    for got in (number_rows(df, ["k"], ["v", "i"], "n"), number_rows_sliced(df, ["k"], ["v", "i"], "n")):
        assert {(r["k"], r["i"]): r["n"] for r in got.collect()} == want


def test_running_sum_and_min(skewed):
    rows, df = skewed
    total, low, sums, mins = {}, {}, {}, {}
    for k, v, i in sorted(rows, key=lambda r: (r[0], r[2])):
        sums[k, i], mins[k, i] = total.get(k, 0), low.get(k)
        total[k] = total.get(k, 0) + i
        low[k] = min(low.get(k, float("inf")), v)
    slices = F.floor(F.col("i") / 100)
    got = running_sum(df, ["k"], slices, ["i"], "i", "s")
    assert {(r["k"], r["i"]): r["s"] for r in got.collect()} == sums
    got = running_min(df, ["k"], slices, ["i"], "v", "m")
    assert {(r["k"], r["i"]): r["m"] for r in got.collect()} == mins


def test_explode_range(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", None), ("d", 3)], "k string, n int")
    got = sorted((r["k"], r["j"]) for r in explode_range(df, "n", "j", chunk=4).collect())
    assert got == [("a", j) for j in range(1, 11)] + [("d", j) for j in (1, 2, 3)]


def test_genes_keep_their_place_when_others_are_missing(spark):
    rows = [("s", 0, 1, 5), ("s", 2, 0, 7), ("t", 1, 1, 4)]
    genes = spark.createDataFrame(rows, "scenario_id string, od_idx int, bin_idx int, value int")
    arrays = demand.collapse_genome(genes, 3, 2)
    assert {r["scenario_id"]: (r["genes"], r["complete"]) for r in arrays.collect()} == {
        "s": ([None, 5, None, None, 7, None], False), "t": ([None, None, None, 4, None, None], False)
    }
    back = demand.explode_genome(arrays, 2).select("scenario_id", "od_idx", "bin_idx", "value")
    assert sorted(map(tuple, back.collect())) == rows
