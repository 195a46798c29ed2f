"""Candidate populations of many runs: statistics, ranking, selection, variation, replacement.

Random numbers are hashes of (seed, run, generation, individual, gene, purpose), so a result never depends on how
the rows are partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.functions import keys as K, scoring
from roadweave.functions.scoring import effective_e_loss, effective_fail_total, effective_penalty, is_feasible
from roadweave.operators.ordering import explode_range, number_rows, running_min
from roadweave.session import pickle_by_value

pickle_by_value(__name__)

# Fixed value: at most this many pairs enter the genotypic diversity of a generation while a search runs.
DIVERSITY_PAIRS = 200
STEP_SLICE = 1024
# Members of a block, and of a strip of it, when all pairs are measured.
PAIR_BLOCK = 2048
PAIR_STRIP = 256

METRIC_FIELDS = (
    "e_loss", "fail_total", "routing_failures", "teleports", "reliability_penalty", "zero_flow_edges",
    "total_vehicles", "avg_trip_duration", "avg_waiting_time", "worker_error", "error",
)


def gene_sum(genes: Column) -> Column:
    return F.aggregate(genes, F.lit(0).cast("bigint"), lambda acc, g: acc + g)


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def genotypic_diversity(pop: DataFrame, max_pairs: int | None, seed: int = 42) -> DataFrame:
    """Mean pairwise L2 distance per (run, generation) over the first ``max_pairs`` pairs of a hash shuffle, None for all pairs.

    The pair numbers are turned into positions directly, so with a limit neither all pairs nor all members are ever
    listed: the first ``max_pairs`` pairs touch at most ``max_pairs + 1`` members. All pairs are measured block by block.
    """
    keys = ["run_id", "generation"]
    if max_pairs is None:
        return _diversity_of_all_pairs(pop, keys)
    sizes = pop.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shuffled = W.partitionBy(*keys).orderBy(K.uniform(seed, *keys, "individual_id", F.lit("diversity")), "individual_id")
    members = pop.select(*keys, "individual_id", "genes").withColumn("_r", F.row_number().over(shuffled))
    members = members.where(F.col("_r") <= max_pairs + 1).select(*keys, (F.col("_r") - 1).cast("bigint").alias("pos"), "genes")
    n, p = F.col("n"), F.col("p")
    every = F.floor(n * (n - 1) / 2)
    root = F.floor((2 * n - 1 - F.sqrt((2 * n - 1).cast("double") * (2 * n - 1) - p * 8)) / 2)
    i = F.when(p < n - 1, F.lit(0).cast("bigint")).otherwise(root)
    pairs = (
        sizes.where("n >= 2")
        .withColumn("m", F.least(F.lit(max_pairs).cast("bigint"), every))
        .select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("p"))
        .withColumn("i", i)
        .withColumn("j", p - F.floor(F.col("i") * (2 * n - F.col("i") - 1) / 2) + F.col("i") + 1)
    )
    left = members.select(*keys, F.col("pos").alias("i"), F.col("genes").alias("a"))
    right = members.select(*keys, F.col("pos").alias("j"), F.col("genes").alias("b"))
    measured = (
        pairs.join(left, [*keys, "i"]).join(right, [*keys, "j"])
        .groupBy(*keys).agg(F.avg(l2(F.col("a"), F.col("b"))).alias("genotypic_diversity"))
    )
    return sizes.select(*keys).join(measured, keys, "left").fillna(0.0, ["genotypic_diversity"])


def _squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact for integers: by one product while its terms stay exact, else by differences."""
    a, b = (left**2).sum(axis=1), (right**2).sum(axis=1)
    if max(a.max(), b.max()) < 2**51:
        return a[:, None] + b - 2 * (left @ right.T)
    return np.array([((right - row) ** 2).sum(axis=1) for row in left])


def _block_distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum and number of the distances between two blocks of members, or within one."""
    head = rows.iloc[[0]][["run_id", "generation"]]
    first = np.array(rows.loc[~rows["_later"], "genes"].tolist(), dtype=float)
    later = np.array(rows.loc[rows["_later"], "genes"].tolist(), dtype=float)
    within = rows["_low"].iloc[0] == rows["_high"].iloc[0]
    total, n = 0.0, 0
    for at in range(0, len(first), PAIR_STRIP):
        strip = first[at:at + PAIR_STRIP]
        others = first[at:] if within else later
        if not len(others):
            continue
        squares = _squared_distances(strip, others)
        if within:
            squares = squares[np.triu_indices(len(strip), 1, len(others))]
        total, n = total + float(np.sqrt(squares).sum()), n + squares.size
    return head.assign(total=total, n=n)


def _diversity_of_all_pairs(pop: DataFrame, keys: list[str]) -> DataFrame:
    """The work is quadratic in a population; a task holds two blocks of it. Only genomes of equal length have a distance."""
    whole = pop.select(*keys, "individual_id", "genes").where(F.col("genes").isNotNull() & F.forall("genes", lambda g: g.isNotNull()))
    whole = whole.withColumn("_length", F.size("genes"))
    group = [*keys, "_length"]
    blocks = whole.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).alias("_blocks"))
    own = whole.join(blocks, group).withColumn("_own", F.pmod(F.xxhash64("individual_id", "genes"), "_blocks"))
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).select(
        *group, F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"),
        (F.col("_own") > F.col("_other")).alias("_later"), "genes",
    )
    kinds = {f.name: f.dataType.simpleString() for f in pop.schema.fields}
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "total double", "n bigint"])
    measured = met.groupBy(*group, "_low", "_high").applyInPandas(_block_distances, ddl)
    every = pop.select(*keys, F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n")).distinct()
    mean = F.when(F.sum("n") > 0, F.sum("total") / F.sum("n")).otherwise(0.0)
    return every.union(measured).groupBy(*keys).agg(mean.alias("genotypic_diversity"))


def phenotypic_diversity(pop: DataFrame) -> DataFrame:
    """Population standard deviation of the known losses; 0 below two."""
    return pop.groupBy("run_id", "generation").agg(
        F.when(F.count("loss") < 2, 0.0).otherwise(F.stddev_pop("loss")).alias("phenotypic_diversity")
    )


def generation_stats(pop: DataFrame, boosts: DataFrame | None = None, *, diversity_pairs: int | None) -> DataFrame:
    """The fifteen per-generation figures; the best individual is the first one on equal loss.

    The genotypic diversity takes ``diversity_pairs`` pairs, None for all.
    """
    m = {name: F.col("metrics")[name] for name in METRIC_FIELDS}
    fails = effective_fail_total(m)
    best_row = F.struct(
        gene_sum(F.col("genes")).cast("double").alias("magnitude"),
        m["zero_flow_edges"].alias("zero_flow"),
        m["routing_failures"].alias("routing_failures"),
        fails.alias("fail_total"),
    )
    zero_flow = m["zero_flow_edges"].cast("double")
    stats = pop.where("loss is not null").groupBy("run_id", "generation").agg(
        F.min("loss").alias("best_loss"),
        F.avg("loss").alias("mean_loss"),
        F.stddev_pop("loss").alias("std_loss"),
        F.min_by(best_row, F.struct("loss", "individual_id")).alias("_best"),
        F.avg(gene_sum(F.col("genes"))).alias("mean_magnitude"),
        F.avg(F.when(scoring.is_finite(zero_flow), zero_flow)).alias("mean_zero_flow"),
        F.avg(m["routing_failures"]).alias("mean_routing_failures"),
        F.avg(fails).alias("mean_fail_total"),
        F.when(F.count("loss") < 2, 0.0).otherwise(F.stddev_pop("loss")).alias("phenotypic_diversity"),
    )
    joined = stats.join(genotypic_diversity(pop, diversity_pairs), ["run_id", "generation"], "left")
    if boosts is None:
        joined = joined.withColumn("mutation_boosted", F.lit(False))
    else:
        flags = boosts.select("run_id", "generation", F.col("boosted").alias("mutation_boosted"))
        joined = joined.join(flags, ["run_id", "generation"], "left").fillna(False, ["mutation_boosted"])
    return joined.select(
        "run_id", "generation", "best_loss", "mean_loss", "std_loss",
        F.col("_best.magnitude").alias("best_magnitude"), "mean_magnitude",
        F.col("_best.zero_flow").alias("best_zero_flow"), "mean_zero_flow",
        F.col("_best.routing_failures").alias("best_routing_failures"), "mean_routing_failures",
        F.col("_best.fail_total").alias("best_fail_total"), "mean_fail_total",
        "genotypic_diversity", "phenotypic_diversity", "mutation_boosted",
    )


def e_rank(pop: DataFrame) -> DataFrame:
    """0-based rank by flow-fit error within (run, generation); first individual first on ties."""
    ranked = pop.withColumn("e_eff", effective_e_loss(F.col("loss"), F.col("metrics")))
    return number_rows(ranked, ["run_id", "generation"], ["e_eff", "individual_id"], "e_rank")


def top_k(pop: DataFrame, k: int, order: str = "loss") -> DataFrame:
    """Best ``k`` per (run, generation); the limit is applied before the shuffle."""
    best = W.partitionBy("run_id", "generation").orderBy(F.col(order).asc_nulls_last(), "individual_id")
    return pop.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def parent_scores(pop: DataFrame, elite_pct: float = 0.1, magnitude_weight: float = 0.001) -> DataFrame:
    """Candidate pool and selection score per (run, generation).

    With enough feasible individuals the best of them by error compete on magnitude and error rank; otherwise all
    compete on error plus penalty. ``pool_idx`` numbers the pool in error order.
    """
    keys = ["run_id", "generation"]
    ranked = e_rank(pop.withColumn("feasible", is_feasible(F.col("loss"), F.col("metrics"))))
    counts = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("feasible").alias("feasible_count")
    ).withColumn("elite_count", F.greatest(F.lit(1).cast("bigint"), (F.col("n") * elite_pct).cast("bigint")))
    feasible = number_rows(ranked.where("feasible").select(*keys, "individual_id", "e_rank"), keys, ["e_rank"], "f_rank")
    joined = ranked.join(counts, keys).join(feasible.drop("e_rank"), [*keys, "individual_id"], "left")
    strict = F.col("feasible_count") >= F.col("elite_count")
    rank_term = F.col("e_rank") / F.greatest(F.lit(1), F.col("n") - 1)
    score = F.when(strict, gene_sum(F.col("genes")) * magnitude_weight + rank_term).otherwise(
        F.col("e_eff") + effective_penalty(F.col("loss"), F.col("metrics"))
    )
    return joined.where(~strict | (F.col("f_rank") < F.col("elite_count"))).select(
        *keys, "individual_id", "genes", "loss", "metrics",
        score.alias("score"),
        F.when(strict, "feasible_elite").otherwise("fallback").alias("mode"),
        F.when(strict, F.col("f_rank")).otherwise(F.col("e_rank")).alias("pool_idx"),
        F.when(strict, F.col("elite_count")).otherwise(F.col("n")).alias("pool_size"),
        F.col("n").alias("population_size"), "elite_count", "feasible_count",
    )


def tournament(scores: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """As many winners per run as its population: each the lowest score of ``size`` draws, the first on ties."""
    keys = ["run_id", "generation"]
    runs = scores.groupBy(*keys).agg(F.max("population_size").alias("n"), F.max("pool_size").alias("pool"))
    aspirants = (
        explode_range(runs, "n", "slot")
        .select(*keys, "pool", "slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
        .where(F.col("k") < F.greatest(F.lit(1).cast("bigint"), F.col("pool")))
        .withColumn("pool_idx", K.uniform_int(F.col("pool"), seed, "run_id", "generation", "slot", "k", F.lit("tournament")))
    )
    met = aspirants.join(
        scores.select(*keys, "pool_idx", "individual_id", "genes", "loss", "metrics", "score"), [*keys, "pool_idx"]
    )
    winners = met.groupBy(*keys, "slot").agg(
        F.min_by(F.struct("individual_id", "genes", "loss", "metrics"), F.struct("score", "k")).alias("w")
    )
    return winners.select(
        *keys, (F.col("slot") - 1).alias("child_id"), F.col("w.individual_id").alias("parent_id"),
        F.col("w.genes").alias("genes"), F.col("w.loss").alias("loss"), F.col("w.metrics").alias("metrics"),
    )


def mate_pairs(parents: DataFrame, assortative: bool = True) -> DataFrame:
    """Pairs (pair_no, child_a, child_b) with their genes.

    Assortative: the k-th smallest genome sum with the k-th largest; otherwise neighbours in order. The odd one out
    stays unpaired.
    """
    keys = ["run_id", "generation"]
    sizes = parents.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    with_sum = parents.withColumn("_sum", gene_sum(F.col("genes")))
    if assortative:
        ranked = number_rows(with_sum, keys, ["_sum", "child_id"], "_r").join(sizes, keys)
        pair_no = F.least(F.col("_r"), F.col("n") - 1 - F.col("_r"))
    else:
        ranked = number_rows(with_sum, keys, ["child_id"], "_r").join(sizes, keys)
        pair_no = F.floor(F.col("_r") / 2)
    member = F.struct("child_id", "genes")
    return (
        ranked.withColumn("pair_no", pair_no)
        .groupBy(*keys, "pair_no")
        .agg(F.min_by(member, "_r").alias("a"), F.max_by(member, "_r").alias("b"), F.count(F.lit(1)).alias("_n"))
        .where("_n = 2")
        .select(
            *keys, "pair_no", F.col("a.child_id").alias("child_a"), F.col("b.child_id").alias("child_b"),
            F.col("a.genes").alias("genes_a"), F.col("b.genes").alias("genes_b"),
        )
    )


def crossover(pairs: DataFrame, rate: float = 0.7, seed: int = 42) -> DataFrame:
    """Two-point crossover; both children of a crossed pair lose their evaluation. One row per child."""
    keys = ["run_id", "generation"]
    tag = (*keys, "pair_no")
    length = F.least(F.size("genes_a"), F.size("genes_b"))
    first = K.uniform_int(F.greatest(length, F.lit(1)), seed, *map(F.col, tag), F.lit("cx1")) + 1
    second = K.uniform_int(F.greatest(length - 1, F.lit(1)), seed, *map(F.col, tag), F.lit("cx2")) + 1
    drawn = (
        pairs.withColumn(
            "crossed", (K.uniform(seed, *map(F.col, tag), F.lit("cross")) < rate)
        )
        .withColumn("_c1", first)
        .withColumn("_c2", F.when(second >= first, second + 1).otherwise(second))
        .withColumn("cut_low", F.least("_c1", "_c2"))
        .withColumn("cut_high", F.greatest("_c1", "_c2"))
    )
    swap = F.col("crossed") & (length >= 2)

    def mixed(own: str, other: str) -> Column:
        low, high = F.col("cut_low").cast("int"), F.col("cut_high").cast("int")
        parts = F.concat(
            F.slice(own, F.lit(1), low), F.slice(other, low + 1, high - low),
            F.slice(own, high + 1, F.greatest(F.size(own) - high, F.lit(0))),
        )
        return F.when(swap, parts).otherwise(F.col(own))

    children = F.array(
        F.struct(F.col("child_a").alias("child_id"), mixed("genes_a", "genes_b").alias("genes")),
        F.struct(F.col("child_b").alias("child_id"), mixed("genes_b", "genes_a").alias("genes")),
    )
    return drawn.select(*keys, "pair_no", "crossed", "cut_low", "cut_high", F.explode(children).alias("c")).select(
        *keys, "pair_no", F.col("c.child_id").alias("child_id"), F.col("c.genes").alias("genes"), "crossed",
        "cut_low", "cut_high",
    )


def mutate(
    children: DataFrame, rate: Column | float = 0.5, sigma: Column | float = 20.0, indpb: float = 0.3,
    lower: Column | int = 0, seed: int = 42,
) -> DataFrame:
    """Truncated Gaussian steps on single genes, floored at the lower bound, no upper cap. Adds ``mutated``."""
    ident = [F.col(c) for c in ("run_id", "generation", "child_id")]
    rate, sigma, lower = (v if isinstance(v, Column) else F.lit(v) for v in (rate, sigma, lower))

    def step(gene: Column, i: Column) -> Column:
        # Box-Muller from two hashed uniforms; 1 - u keeps the logarithm finite.
        u1 = K.uniform(seed, *ident, i, F.lit("mutate-radius"))
        u2 = K.uniform(seed, *ident, i, F.lit("mutate-angle"))
        normal = F.sqrt(F.log(F.lit(1.0) - u1) * -2.0) * F.cos(u2 * (2 * np.pi))
        moved = F.greatest(lower.cast("int"), gene + (normal * sigma).cast("int"))
        return F.when(K.uniform(seed, *ident, i, F.lit("mutate-gene")) < indpb, moved).otherwise(gene)

    chosen = K.uniform(seed, *ident, F.lit("mutate-individual")) < rate
    return children.withColumn("mutated", chosen).withColumn(
        "genes", F.when(F.col("mutated"), F.transform("genes", step)).otherwise(F.col("genes"))
    )


def random_candidates(runs: DataFrame, seed: int = 42, purpose: str = "init") -> DataFrame:
    """``runs``: run_id, generation, n, genome_size, lower_bound, upper_bound, activation (null = dense)."""
    individuals = explode_range(runs, "n", "_i")
    ident = [F.col(c) for c in ("run_id", "generation", "_i")]
    span = F.col("upper_bound") - F.col("lower_bound") + 1

    def gene(i: Column) -> Column:
        value = (F.col("lower_bound") + K.uniform_int(span, seed, *ident, i, F.lit(purpose))).cast("int")
        active = K.uniform(seed, *ident, i, F.lit(purpose + "-active")) < F.col("activation")
        return F.when(F.col("activation").isNull() | active, value).otherwise(F.lit(0))

    return individuals.select(
        "run_id", "generation", (F.col("_i") - 1).alias("individual_id"),
        F.transform(F.sequence(F.lit(0), F.col("genome_size").cast("int") - 1), gene).alias("genes"),
    )


def best_individuals(pop: DataFrame) -> DataFrame:
    """Best raw and best feasible individual of each run over all generations; the earliest wins ties."""
    order = ("generation", "individual_id")
    e_loss = effective_e_loss(F.col("loss"), F.col("metrics"))
    finite = F.col("loss") < float("inf")
    feasible = is_feasible(F.col("loss"), F.col("metrics")) & (e_loss < float("inf"))
    who = F.struct("generation", "individual_id", "genes")
    last = F.max_by(F.struct(F.col("loss").alias("loss"), who.alias("who")), F.struct("generation", -F.col("individual_id")))
    found = pop.where("loss is not null").groupBy("run_id").agg(
        F.min(F.when(finite, F.col("loss"))).alias("best_raw_loss"),
        F.min_by(who, F.when(finite, F.struct("loss", *order))).alias("_raw"),
        F.min(F.when(feasible, e_loss)).alias("best_feasible_e_loss"),
        F.min_by(who, F.when(feasible, F.struct(e_loss.alias("e"), *order))).alias("_feasible"),
        last.alias("_last"),
    )
    has_feasible = F.col("best_feasible_e_loss").isNotNull()
    chosen = F.when(has_feasible, F.col("_feasible")).otherwise(F.coalesce("_raw", F.col("_last.who")))
    return found.withColumn("_chosen", chosen).select(
        "run_id",
        F.when(has_feasible, "feasible").otherwise("raw").alias("selected_mode"),
        F.coalesce("best_feasible_e_loss", "best_raw_loss", F.col("_last.loss")).alias("selected_value"),
        F.coalesce("best_raw_loss", F.lit(float("inf"))).alias("best_raw_loss"),
        "best_feasible_e_loss",
        F.col("_chosen.generation").alias("generation"),
        F.col("_chosen.individual_id").alias("individual_id"),
        F.col("_chosen.genes").alias("genes"),
    )


def stagnation(
    stats: DataFrame, patience: int = 20, boost: float = 1.5, epsilon: float = 0.1, sigma: float = 20.0, rate: float = 0.5
) -> DataFrame:
    """Stagnation counter and boosted mutation per generation.

    The reference loss moves only when a generation beats it by more than ``epsilon``, which a running minimum does
    not express. But every such generation is also a new running minimum, so only those few rows are folded in
    order; all others look up the latest move before them.
    """
    ordered = stats.select("run_id", "generation", "best_loss")
    slices = F.floor(F.col("generation") / STEP_SLICE)
    marked = running_min(ordered, ["run_id"], slices, ["generation"], "best_loss", "_before")
    records = marked.where(F.col("_before").isNull() | (F.col("best_loss") < F.col("_before")))
    point = F.struct("generation", "best_loss")
    start = F.struct(
        F.lit(float("inf")).alias("ref"), F.array().cast("array<bigint>").alias("moves")
    )

    def fold(acc: Column, p: Column) -> Column:
        moved = p["best_loss"] < acc["ref"] - epsilon
        return F.struct(
            F.when(moved, p["best_loss"]).otherwise(acc["ref"]).alias("ref"),
            F.when(moved, F.concat(acc["moves"], F.array(p["generation"].cast("bigint")))).otherwise(acc["moves"]).alias("moves"),
        )

    moves = records.groupBy("run_id").agg(F.array_sort(F.collect_list(point)).alias("_points")).select(
        "run_id", F.aggregate("_points", start, fold)["moves"].alias("_moves")
    )
    at = moves.select("run_id", F.explode("_moves").alias("generation"), F.lit(True).alias("_moved"))
    flagged = (
        ordered.withColumn("generation", F.col("generation").cast("bigint"))
        .join(at, ["run_id", "generation"], "left")
        .withColumn("_pos", F.when(F.col("_moved"), F.col("generation")))
        .withColumn("_neg", -F.col("_pos"))
    )
    latest = running_min(flagged, ["run_id"], slices, ["generation"], "_neg", "_latest")
    first = ordered.groupBy("run_id").agg(F.min("generation").cast("bigint").alias("_first"))
    # Generations since the last move, counted before this one: generations are consecutive numbers.
    counter = F.when(F.col("_latest").isNull(), F.col("generation") - F.col("_first")).otherwise(
        F.col("generation") + F.col("_latest") - 1
    )
    boosted = F.col("stalled") >= patience
    return (
        latest.join(first, "run_id")
        .withColumn("stalled", counter)
        .select(
            "run_id", "generation", "best_loss", F.coalesce("_moved", F.lit(False)).alias("improved"), "stalled",
            boosted.alias("boosted"),
            F.when(boosted, F.lit(int(sigma * boost))).otherwise(F.lit(sigma)).cast("double").alias("sigma"),
            F.when(boosted, F.lit(min(1.0, rate * boost))).otherwise(F.lit(float(rate))).alias("rate"),
        )
    )


def checkpoints(pop: DataFrame, every: int = 10) -> DataFrame:
    """Best individual of every ``every``-th generation with its metrics."""
    due = pop.where(F.col("generation") % max(1, every) == 0)
    best = due.where("loss is not null").groupBy("run_id", "generation").agg(
        F.min_by(F.struct("individual_id", "genes", "loss", "metrics"), F.struct("loss", "individual_id")).alias("b")
    )
    return best.select("run_id", "generation", "b.individual_id", "b.genes", "b.loss", "b.metrics").withColumn(
        "trip_count", gene_sum(F.col("genes"))
    )


# ---- replacement -----------------------------------------------------------------------------------------------

def _crowd(members: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
    """Children in order replace their nearest member when they beat it, seeing earlier replacements."""
    if members.empty:
        return members
    kept = members.sort_values("individual_id").reset_index(drop=True)
    genomes = np.array(kept["genes"].tolist(), dtype=float)
    norms = (genomes**2).sum(axis=1)
    losses = kept["loss"].to_numpy(dtype=float).copy()
    source = np.full(len(kept), -1)
    young = children.dropna(subset=["loss"]).sort_values("individual_id").reset_index(drop=True)
    for row, (genes, loss) in enumerate(zip(young["genes"], young["loss"])):
        genes = np.asarray(genes, dtype=float)
        # Squared distances without the child's own norm: exact for integers, one pass over the members.
        near = int(np.argmin(norms - 2 * (genomes @ genes)))
        if loss < losses[near]:
            genomes[near], losses[near], source[near], norms[near] = genes, loss, row, genes @ genes
    taken = source >= 0
    result = kept.copy()
    if taken.any():
        replacement = young.iloc[source[taken]]
        for column in ("genes", "loss", "metrics_json"):
            values = result[column].to_numpy(dtype=object, copy=True)
            values[taken] = replacement[column].to_numpy(dtype=object)
            result[column] = values
    result["loss"] = result["loss"].astype(float)
    return result


def crowd(members: DataFrame, children: DataFrame) -> DataFrame:
    """Deterministic crowding per (run, generation): children are tried one after the other, each sees what the earlier
    ones replaced. One grouped task per population, so the population size is the bound of a task."""
    keys = ["run_id", "generation"]
    # Fresh column ids: both sides may descend from the same table.
    fresh = children.toDF(*children.columns)
    return members.groupBy(*keys).cogroup(fresh.groupBy(*keys)).applyInPandas(_crowd, members.schema)


def replace_population(
    pop: DataFrame, children: DataFrame, immigrants: DataFrame | None, elitism: int = 2, crowding: bool = True,
    population_size: int | None = 50,
) -> DataFrame:
    """The next population: elites stay, children compete, immigrants overwrite the worst, size is kept.

    All inputs: run_id, generation, individual_id, genes, loss, metrics. Members that equal an elite are dropped
    before crowding, so the population may shrink. The members and the children of one generation meet in one task while
    they crowd; ``population_size`` limits the result only, with None (crowding only) every member stays.
    """
    if population_size is None and not crowding:
        raise ValueError("population_size may be None with crowding only")
    keys = ["run_id", "generation"]
    metrics_type = pop.schema["metrics"].dataType
    columns = [*keys, "individual_id", "genes", "loss", "metrics_json"]

    def flat(df: DataFrame) -> DataFrame:
        return df.withColumn("metrics_json", F.to_json("metrics", {"ignoreNullFields": "false"})).select(*columns)

    pop, children = flat(pop), flat(children)
    elites = top_k(pop, elitism)
    tagged_elites = elites.withColumn("_part", F.lit(0))
    if crowding:
        rest = pop.join(elites.select(*keys, "genes").distinct(), [*keys, "genes"], "left_anti").select(*columns)
        filled = crowd(rest, children.select(*columns)).withColumn("_part", F.lit(1))
    else:
        numbered = number_rows(children, keys, ["individual_id"], "_n")
        filled = numbered.where(F.col("_n") < population_size - elitism).drop("_n").withColumn("_part", F.lit(1))
    merged = tagged_elites.select(*columns, "_part").unionByName(filled.select(*columns, "_part"))
    order = ["_part", "individual_id"]
    # Elites in loss order first, then the others in their own order.
    merged = merged.withColumn("_l", F.when(F.col("_part") == 0, F.col("loss")).otherwise(0.0))
    placed = number_rows(merged, keys, ["_part", "_l", "individual_id"], "_pos")
    if immigrants is not None:
        ranked = number_rows(placed.drop("_part", "_l"), keys, ["loss", "_pos"], "_rank")
        sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        news = number_rows(flat(immigrants.where("loss is not null")), keys, ["individual_id"], "_i").select(
            *keys, F.col("_i"), F.col("genes").alias("i_genes"), F.col("loss").alias("i_loss"),
            F.col("metrics_json").alias("i_metrics"),
        )
        # Immigrant i takes the i-th place from the end.
        joined = (
            ranked.join(sizes, keys).withColumn("_i", F.col("_n") - 1 - F.col("_rank")).join(news, [*keys, "_i"], "left")
        )
        taken = F.col("i_loss").isNotNull()
        placed = joined.select(
            *keys, F.col("_rank").alias("_pos"),
            F.when(taken, F.col("i_genes")).otherwise(F.col("genes")).alias("genes"),
            F.when(taken, F.col("i_loss")).otherwise(F.col("loss")).alias("loss"),
            F.when(taken, F.col("i_metrics")).otherwise(F.col("metrics_json")).alias("metrics_json"),
        )
    kept = placed if population_size is None else placed.where(F.col("_pos") < population_size)
    return kept.select(
        *keys, F.col("_pos").alias("individual_id"), "genes", "loss",
        F.from_json("metrics_json", metrics_type, {"allowNonNumericNumbers": "true"}).alias("metrics"),
    )
