import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave import schema as S
from roadweave.functions import keys as K
from roadweave.operators import population as P
from roadweave.plans import search

MEMBER = "run_id string, generation int, individual_id int, genes array<int>, loss double, metrics struct<{}>"


def ddl():
    return MEMBER.format(", ".join(p.strip().replace(" ", ": ", 1) for p in S.METRICS.split(",")))


def metrics(**given):
    names = [p.strip().split(" ")[0] for p in S.METRICS.split(",")]
    return tuple(given.get(n) for n in names)


def members(spark, rows, run="r", generation=0):
    """rows: (genes, loss, metrics dict)."""
    return spark.createDataFrame(
        [(run, generation, i, list(g), loss, metrics(**m)) for i, (g, loss, m) in enumerate(rows)], ddl()
    )


def test_diversities(spark):
    spread = members(spark, [((0, 0, 0), 10.0, {}), ((10, 10, 10), 20.0, {}), ((5, 5, 5), 30.0, {})])
    same = members(spark, [((1, 2), 5.0, {})] * 3)
    assert P.genotypic_diversity(spread, None).first()["genotypic_diversity"] == pytest.approx(20 * math.sqrt(3) / 3)
    assert P.genotypic_diversity(same, 200).first()["genotypic_diversity"] == 0
    assert P.phenotypic_diversity(spread).first()["phenotypic_diversity"] == pytest.approx(8.165, abs=1e-3)
    assert P.phenotypic_diversity(same).first()["phenotypic_diversity"] == 0
    assert P.genotypic_diversity(members(spark, [((1, 2), 5.0, {})]), 200).first()["genotypic_diversity"] == 0


@pytest.mark.parametrize(("n", "limit"), [(250, 200), (12, 7)])
def test_diversity_uses_the_first_pairs_of_one_shuffle(spark, n, limit):
    rnd = random.Random(n)
    genes = [[rnd.randrange(50) for _ in range(4)] for _ in range(n)]
    pop = members(spark, [(g, 1.0, {}) for g in genes])
    order = [r["individual_id"] for r in pop.orderBy(K.uniform(42, "run_id", "generation", "individual_id", F.lit("diversity")), "individual_id").collect()]
    pairs = [(order[i], order[j]) for i in range(n) for j in range(i + 1, n)][:limit]
    want = sum(math.dist(genes[a], genes[b]) for a, b in pairs) / len(pairs)
    assert P.genotypic_diversity(pop, limit).first()["genotypic_diversity"] == pytest.approx(want)


def test_parent_selection_modes(spark):
    rows = [((1, 1), 5.0, {"fail_total": 0.0, "e_loss": 5.0}), ((2, 2), 4.0, {"fail_total": 0.0, "e_loss": 4.0}),
            ((3, 3), 3.0, {"fail_total": 1.0, "e_loss": 3.0}), ((4, 4), 6.0, {"fail_total": 0.0, "e_loss": 6.0}), ((5, 5), 9.0, {"fail_total": 2.0, "e_loss": 8.0})]
    strict = P.parent_scores(members(spark, rows), 0.4, 0.005).orderBy("pool_idx").collect()
    assert [(r["individual_id"], r["mode"], r["elite_count"], r["feasible_count"]) for r in strict] == [(1, "feasible_elite", 2, 3), (0, "feasible_elite", 2, 3)]
    assert strict[0]["score"] == pytest.approx(0.005 * 4 + 1 / 4)
    loose = P.parent_scores(members(spark, [rows[0], *rows[2:3] * 4]), 0.4).collect()
    assert len(loose) == 5 and {r["mode"] for r in loose} == {"fallback"}


def test_smaller_genomes_score_lower(spark):
    rows = [((100,), 1.0, {"fail_total": 0.0}), ((1,), 1.0, {"fail_total": 0.0})]
    scores = {r["individual_id"]: r["score"] for r in P.parent_scores(members(spark, rows), 1.0, 0.05).collect()}
    assert scores[1] < scores[0]


def test_tournament_prefers_low_scores(spark):
    pop = members(spark, [((i,), float(i), {"fail_total": 1.0}) for i in range(40)])
    scores = P.parent_scores(pop)
    winners = [r["parent_id"] for r in P.tournament(scores).collect()]
    again = [r["parent_id"] for r in P.tournament(scores.repartition(5)).orderBy("child_id").collect()]
    assert len(winners) == 40 and sum(winners) / 40 < 16
    assert sorted(winners) == sorted(again)


def children(spark, genes):
    return spark.createDataFrame([("r", 0, i, list(g)) for i, g in enumerate(genes)], "run_id string, generation int, child_id int, genes array<int>")


def test_mate_pairs(spark):
    parents = children(spark, [(30,), (3,), (60,), (15,), (7,)])
    pairs = {(r["child_a"], r["child_b"]) for r in P.mate_pairs(parents.where("child_id < 4")).collect()}
    assert pairs == {(1, 2), (3, 0)}
    assert P.mate_pairs(parents).count() == 2
    assert {(r["child_a"], r["child_b"]) for r in P.mate_pairs(parents, False).collect()} == {(0, 1), (2, 3)}


def test_crossover_swaps_one_stretch(spark):
    rnd = random.Random(1)
    parents = children(spark, [[rnd.randrange(1000) for _ in range(12)] for _ in range(80)])
    pairs = P.mate_pairs(parents)
    genes = {r["child_id"]: r["genes"] for r in parents.collect()}
    mates = {}
    for r in pairs.collect():
        mates[r["child_a"]], mates[r["child_b"]] = r["child_b"], r["child_a"]
    rows = P.crossover(pairs, 0.7).collect()
    crossed = [r for r in rows if r["crossed"]]
    assert len(rows) == 80 and 0.5 < len(crossed) / 80 < 0.9
    for r in rows:
        own, other = genes[r["child_id"]], genes[mates[r["child_id"]]]
        low, high = r["cut_low"], r["cut_high"]
        assert 1 <= low < high <= 12
        assert r["genes"] == (own[:low] + other[low:high] + own[high:] if r["crossed"] else own)


def test_short_genomes_are_not_cut(spark):
    rows = P.crossover(P.mate_pairs(children(spark, [(1,), (2,)])), 1.0).collect()
    assert sorted(r["genes"][0] for r in rows) == [1, 2]


def test_mutation_is_floored_and_uncapped(spark):
    kids = children(spark, [[1] * 50 for _ in range(60)])
    rows = P.mutate(kids, 1.0, 20.0, 0.5).collect()
    values = [g for r in rows for g in r["genes"]]
    assert min(values) == 0 and max(values) > 20 and 0.35 < sum(v != 1 for v in values) / len(values) < 0.55
    untouched = P.mutate(kids, 0.0, 20.0, 0.5).collect()
    assert all(r["genes"] == [1] * 50 and not r["mutated"] for r in untouched)


def test_random_candidates_stay_in_bounds(spark):
    runs = spark.createDataFrame([("dense", None), ("sparse", 0.2)], "run_id string, activation double").select(
        "*", F.lit(0).alias("generation"), F.lit(30).alias("n"), F.lit(20).alias("genome_size"), F.lit(0).alias("lower_bound"), F.lit(5).alias("upper_bound")
    )
    rows = P.random_candidates(runs).collect()
    genes = {run: [g for r in rows if r["run_id"] == run for g in r["genes"]] for run in ("dense", "sparse")}
    assert set(genes["dense"]) == set(range(6)) and len(genes["dense"]) == 600
    assert genes["dense"].count(0) < 150 < 400 < genes["sparse"].count(0)
    assert sorted(map(str, rows)) == sorted(map(str, P.random_candidates(runs.repartition(3)).collect()))


def fold(losses, patience, epsilon):
    reference, counter, out = math.inf, 0, []
    for best in losses:
        out.append((counter, counter >= patience))
        if best < reference - epsilon:
            reference, counter = best, 0
        else:
            counter += 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_stagnation_equals_a_fold(spark, seed):
    rnd = random.Random(seed)
    runs = {f"r{i}": [100 - 0.06 * g + rnd.choice([0, 0.01, 0.2, 5.0]) for g in range(rnd.randint(1, 90))] for i in range(5)}
    runs["flat"] = [1.0] * 30
    rows = [(run, g + 1, loss) for run, losses in runs.items() for g, loss in enumerate(losses)]
    stats = spark.createDataFrame(rows, "run_id string, generation int, best_loss double").repartition(5)
    got = P.stagnation(stats, patience=4, boost=1.5, epsilon=0.1).collect()
    for run, losses in runs.items():
        mine = [(r["stalled"], r["boosted"]) for r in sorted((r for r in got if r["run_id"] == run), key=lambda r: r["generation"])]
        assert mine == fold(losses, 4, 0.1)
    boosted = next(r for r in got if r["boosted"])
    assert (boosted["sigma"], boosted["rate"]) == (30.0, 0.75)


def crowd_by_hand(old, young):
    old = [list(m) for m in old]
    for genes, loss in young:
        near = min(range(len(old)), key=lambda i: (math.dist(old[i][0], genes), i))
        if loss < old[near][1]:
            old[near] = [genes, loss]
    return sorted((tuple(g), loss) for g, loss in old)


def test_crowding_equals_a_loop(spark):
    rnd = random.Random(6)
    old = [([rnd.randrange(9) for _ in range(3)], rnd.random() * 10) for _ in range(9)]
    young = [([rnd.randrange(9) for _ in range(3)], rnd.random() * 10) for _ in range(6)]
    best = sorted(range(9), key=lambda i: old[i][1])[:2]
    rest = [m for i, m in enumerate(old) if i not in best and m[0] not in [old[b][0] for b in best]]
    want = sorted([(tuple(old[b][0]), old[b][1]) for b in best] + crowd_by_hand(rest, young))
    pop, kids = members(spark, [(g, v, {}) for g, v in old]), members(spark, [(g, v, {}) for g, v in young])
    got = P.replace_population(pop, kids, None, 2, True, 50).collect()
    assert sorted((tuple(r["genes"]), r["loss"]) for r in got) == want
    assert sorted(r["individual_id"] for r in got) == list(range(len(want)))


def test_crowding_query_keeps_every_member(spark, monkeypatch):
    from roadweave.bindings import search
    from roadweave.bindings.registry import QUERIES

    old = members(spark, [((i,), float(i), {}) for i in range(1100)])
    monkeypatch.setattr(search, "_next_generation", lambda spark, d: (old, members(spark, [((1050,), 0.5, {})])))
    got = QUERIES["p7_replace_crowding"](spark, "").collect()
    assert len(got) == 1100 and [r["genes"] for r in got if r["loss"] == 0.5] == ["1050"]


def test_elitism_and_immigrants(spark):
    pop = members(spark, [((i,), float(i), {}) for i in range(6)])
    kids = members(spark, [((10 + i,), 10.0 + i, {"error": "boom"}) for i in range(6)])
    news = members(spark, [((99,), 50.0, {"zero_flow_edges": 3.0}), ((98,), 60.0, {})])
    rows = P.replace_population(pop, kids, news, 2, False, 6).orderBy("individual_id").collect()
    # Two elites, four children; the immigrants take the two worst places, the first one the very last.
    assert [r["genes"][0] for r in rows] == [0, 1, 10, 11, 98, 99]
    assert rows[5]["metrics"]["zero_flow_edges"] == 3.0 and rows[2]["metrics"]["error"] == "boom"


def test_infinite_losses_survive_replacement(spark):
    pop = members(spark, [((i,), math.inf, {"e_loss": math.inf, "worker_error": True}) for i in range(3)])
    kids = members(spark, [((i,), math.inf, {"e_loss": math.inf}) for i in range(3)])
    rows = P.replace_population(pop, kids, None, 1, True, 3).collect()
    assert all(r["loss"] == math.inf and r["metrics"]["e_loss"] == math.inf for r in rows)


def test_generation_stats_fields(spark):
    rows = [((1, 1), 5.0, {"zero_flow_edges": 2.0, "routing_failures": 1.0}), ((2, 2), 3.0, {"fail_total": 4.0}), ((9, 9), 3.0, {"zero_flow_edges": math.inf})]
    r = P.generation_stats(members(spark, rows), diversity_pairs=None).first()
    assert (r["best_loss"], r["best_magnitude"], r["best_fail_total"], r["best_zero_flow"]) == (3.0, 4.0, 4, None)
    assert (r["mean_zero_flow"], r["mean_routing_failures"]) == (2.0, 1.0)
    assert r["mean_fail_total"] == pytest.approx(5 / 3) and r["std_loss"] == pytest.approx(np.std([5, 3, 3])) and len(r) == 16


def test_best_individuals(spark):
    early = members(spark, [((1,), 5.0, {"fail_total": 0.0, "e_loss": 4.0}), ((2,), 2.0, {"fail_total": 3.0})], generation=0)
    late = members(spark, [((3,), 2.0, {"fail_total": 0.0, "e_loss": 4.0})], generation=1)
    r = P.best_individuals(early.union(late)).first()
    assert (r["selected_mode"], r["selected_value"], r["best_raw_loss"], r["generation"], r["genes"]) == ("feasible", 4.0, 2.0, 0, [1])
    failed = P.best_individuals(members(spark, [((7,), math.inf, {"worker_error": True})])).first()
    assert (failed["selected_mode"], failed["selected_value"], failed["genes"]) == ("raw", math.inf, [7])


def evaluator(rows):
    wanted = F.transform("genes", lambda g, i: F.abs(g - (i % 4)).cast("double"))
    return rows.select("run_id", "generation", "individual_id", F.aggregate(wanted, F.lit(0.0), lambda a, v: a + v).alias("loss"))


def test_evolution_lowers_the_loss_and_is_reproducible(spark):
    runs = spark.createDataFrame([("a", 6, 0, 9, None), ("b", 6, 0, 9, 0.5)], "run_id string, genome_size int, lower_bound int, upper_bound int, activation double")
    seen = []

    def callback(pop, progress):
        seen.append(progress)
        raise RuntimeError("must not stop the search")

    options = {"population_size": 16, "sigma": 3.0, "immigrant_rate": 0.1}
    history, stats = search.evolve(runs, evaluator, 3, on_generation=callback, **options)
    best = {(r["run_id"], r["generation"]): r["best_loss"] for r in stats.collect()}
    start = {r["run_id"]: r["m"] for r in history.where("generation = 0").groupBy("run_id").agg(F.min("loss").alias("m")).collect()}
    assert [p.generation for p in seen] == [0, 1, 2, 3] and len(best) == 6
    sizes = {r["generation"]: r["count"] for r in history.groupBy("generation").count().collect()}
    assert all(p.members == sizes[p.generation] and p.failed == 0 for p in seen) and sizes[0] == 32
    assert [p.best_loss for p in seen[1:]] == [min(best["a", g], best["b", g]) for g in (1, 2, 3)]
    for run in "ab":
        assert start[run] >= best[run, 1] >= best[run, 2] >= best[run, 3] and best[run, 3] < start[run]
    _, again = search.evolve(runs.repartition(3), evaluator, 1, **options)
    assert all(best[r["run_id"], r["generation"]] == r["best_loss"] for r in again.collect())


def test_lost_evaluations_become_failures(spark):
    pop = spark.createDataFrame([("r", 0, i, [i]) for i in range(3)], "run_id string, generation int, individual_id int, genes array<int>")
    rows = {r["individual_id"]: r for r in search.evaluate_members(pop, lambda m: evaluator(m).where("individual_id <> 1")).collect()}
    assert rows[1]["loss"] == math.inf and rows[1]["metrics"]["worker_error"] and rows[1]["metrics"]["fail_total"] == 1
    assert rows[0]["loss"] == 0.0 and rows[0]["metrics"]["worker_error"] is None


def test_a_stopped_search_goes_on_as_if_it_never_stopped(spark, tmp_path):
    runs = spark.createDataFrame([("a", 6, 0, 9, None)], "run_id string, genome_size int, lower_bound int, upper_bound int, activation double")
    options = {"population_size": 12, "sigma": 3.0, "immigrant_rate": 0.1}
    _, whole = search.evolve(runs, evaluator, 2, **options)
    calls, root = [], str(tmp_path / "search")

    def counted(rows):
        calls.append(rows.count())
        if len(calls) == 4:
            raise RuntimeError("the cluster went away")
        return evaluator(rows)

    with pytest.raises(RuntimeError):
        search.evolve(runs, counted, 2, root=root, **options)
    # Generation 1 stands; the half-written generation 2 is made anew, without a second look at the first population.
    history, resumed = search.evolve(runs, counted, 2, root=root, **options)
    assert sorted(map(tuple, resumed.collect())) == sorted(map(tuple, whole.collect()))
    assert history.groupBy("generation").count().count() == 3 and len(calls) == 6 and calls[0] == 12
    with pytest.raises(ValueError):
        search.evolve(runs, evaluator, 2, root=root, **{**options, "sigma": 4.0})


def test_equal_genomes_are_evaluated_once(spark, tmp_path):
    rows = [("r", 0, 0, [1, 2]), ("r", 0, 1, [1, 2]), ("r", 0, 2, [3, 3]), ("q", 0, 0, [1, 2]), ("r", 0, 3, None)]
    pop = spark.createDataFrame(rows, "run_id string, generation int, individual_id int, genes array<int>")
    asked = []

    def recording(members):
        asked.append(sorted((r["run_id"], r["individual_id"]) for r in members.collect()))
        return evaluator(members).where("individual_id <> 2")

    store = search.EvaluationStore(spark, str(tmp_path / "store"))
    first = {(r["run_id"], r["individual_id"]): r["loss"] for r in search.evaluate_members(pop, recording, store, "one").collect()}
    again = {(r["run_id"], r["individual_id"]): r["loss"] for r in search.evaluate_members(pop, recording, store, "two").collect()}
    assert asked[0] == [("q", 0), ("r", 0), ("r", 2), ("r", 3)] and asked[1] == [("r", 2), ("r", 3)]
    assert first == again and first["r", 0] == first["r", 1] == first["q", 0] == 2.0 and first["r", 2] == math.inf


@pytest.mark.parametrize("block", [3, 7, 2048])
def test_all_pairs_are_measured_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(P, "PAIR_BLOCK", block)
    monkeypatch.setattr(P, "PAIR_STRIP", 2)
    rnd = random.Random(block)
    genes = [tuple(rnd.randrange(9) for _ in range(5)) for _ in range(20)] + [(1, 2, 3, 4, 5)] * 3 + [(1,)]
    want = [math.dist(a, b) for i, a in enumerate(genes) for b in genes[i + 1:] if len(a) == len(b)]
    pop = members(spark, [(g, 1.0, {}) for g in genes]).union(members(spark, [((4, 4), 1.0, {})], "alone"))
    got = {r["run_id"]: r["genotypic_diversity"] for r in P.genotypic_diversity(pop, None).collect()}
    assert got == {"r": pytest.approx(sum(want) / len(want)), "alone": 0}


@pytest.mark.parametrize("name", ["a11_genotypic_diversity", "a13_generation_stats", "w9_population_series"])
def test_diversity_queries_measure_every_pair(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as driver

    rnd = random.Random(3)
    rows = [(i, [rnd.randrange(-9, 10) / 20 + 0.01 for _ in range(4)], 1) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["generation"]: r["genotypic_diversity"] for r in driver.queries()[name](spark, str(tmp_path)).collect()}
    for generation in (0, 1):
        genes = [[int(float(np.float32(x)) * 20) for x in v] for i, v, _ in rows if i % 2 == generation]
        want = [math.dist(a, b) for i, a in enumerate(genes) for b in genes[i + 1:]]
        assert len(want) > 200 and got[generation] == pytest.approx(sum(want) / len(want), abs=1e-6)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    twin = con.execute(f"select generation, genotypic_diversity from ({driver.oracle_sql()[name]})").fetchall()
    assert dict(twin) == got


def test_distances_of_large_genes_are_exact(spark):
    pop = members(spark, [((1_000_000_007, 3), 1.0, {}), ((1_000_000_000, 7), 1.0, {})])
    assert P.genotypic_diversity(pop, None).first()["genotypic_diversity"] == pytest.approx(math.sqrt(65))


WHOLE_LABELS = ("a11_genotypic_diversity_all_pairs", "p3_tournament", "p3_winners_come_from_the_pool", "p7_replace_crowding", "w4_e_rank_sliced")


@pytest.mark.parametrize("name", WHOLE_LABELS)
def test_a_population_is_a_whole_label(name):
    import __spark_entry__ as driver

    assert "vec_id //" not in driver.oracle_sql()[name]


def test_a_population_grows_with_its_label(spark, tmp_path):
    from roadweave.bindings import proxies

    rows = spark.range(3000).selectExpr("id AS vec_id", "array(1.0F, 2.0F) AS embedding", "cast(id % 2 AS int) AS label")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    runs = proxies.population(spark, str(tmp_path), whole=True).groupBy("run_id", "generation").count().collect()
    assert {(r["run_id"], r["count"]) for r in runs} == {("run_0", 1500), ("run_1", 1500)}
