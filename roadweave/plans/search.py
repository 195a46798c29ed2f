"""Evolution of many runs at once: one Spark step per generation, every generation written to the shared folder.

A generation is a folder that is written anew until its commit record stands in it, so a search that stopped goes on behind
its last committed generation with the same results as one that never stopped. Losses are kept by run and genome: a genome
that comes back, in the same generation or a later one, is not evaluated again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadweave import schema as S
from roadweave.operators import population as P
from roadweave.session import scratch_path
from roadweave.sources.store import holds_results

Evaluate = Callable[[DataFrame], DataFrame]
KEYS = ["run_id", "generation"]
MEMBER = [*KEYS, "individual_id", "genes", "loss", "metrics"]


class Progress(NamedTuple):
    """Figures of one generation over all runs, gathered while it was written. Generation 0 is the first population."""

    generation: int
    members: int
    best_loss: float | None
    failed: int


def genome_key(genes: Column) -> Column:
    return F.sha2(F.to_json(genes), 256)


class EvaluationStore:
    """Losses and metrics by run and genome. Each batch of new genomes is a folder that a repeated step overwrites."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.parts: list[str] = []

    def known(self) -> DataFrame | None:
        """(run_id, genome, loss, metrics) of all batches so far."""
        if not self.parts:
            return None
        schema = S.struct(f"run_id string, genome string, loss double, metrics struct<{S.METRICS.replace(' ', ':').replace(',:', ',')}>")
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in self.parts])

    def add(self, results: DataFrame, part: str) -> None:
        results.select("run_id", "genome", "loss", "metrics").write.mode("overwrite").parquet(f"{self.root}/{part}")
        self.remember(part)

    def remember(self, part: str) -> None:
        if part not in self.parts:
            self.parts.append(part)


def evaluate_members(
    members: DataFrame, evaluate: Evaluate, store: EvaluationStore | None = None, part: str = "batch"
) -> DataFrame:
    """Attach loss and metrics to members. ``evaluate`` maps (run_id, generation, individual_id, genes) to the keys,
    ``loss`` and, if it has any, ``metrics``; a member that gets no loss back counts as failed.

    Equal genomes of a run are evaluated once, as the first member that has them. With a ``store`` genomes known to it are
    not evaluated at all and new results are added as ``part``; a missing result is not stored, so it is asked for again.
    """
    known = members.select(*KEYS, "individual_id", "genes").withColumn("genome", genome_key(F.col("genes")))
    schema = S.struct(S.METRICS)
    first = F.min_by(F.struct("generation", "individual_id", "genes"), F.struct("generation", "individual_id"))
    wanted = known.groupBy("run_id", "genome").agg(first.alias("_m"))
    stored = store.known() if store else None
    if stored is not None:
        wanted = wanted.join(stored.select("run_id", "genome"), ["run_id", "genome"], "left_anti")
    asked = wanted.select("run_id", "genome", "_m.*")
    result = evaluate(asked.select(*KEYS, "individual_id", "genes"))
    if "metrics" not in result.columns:
        result = result.withColumn("metrics", F.lit(None).cast(schema))
    metrics = F.coalesce(F.col("metrics").cast(schema), F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]))
    given = result.select(*KEYS, "individual_id", F.col("loss").cast("double").alias("loss"), metrics.alias("metrics"))
    found = asked.join(given.where("loss is not null"), [*KEYS, "individual_id"]).select("run_id", "genome", "loss", "metrics")
    if store:
        store.add(found, part)
        found = store.known()
    joined = known.join(found, ["run_id", "genome"], "left")
    lost = F.col("loss").isNull()
    failed = F.struct(
        *[
            F.lit(v).cast(schema[n].dataType).alias(n)
            for n, v in (
                ("e_loss", float("inf")), ("fail_total", 1), ("routing_failures", 1), ("teleports", 0),
                ("reliability_penalty", float("inf")), ("zero_flow_edges", None), ("total_vehicles", 0),
                ("avg_trip_duration", 0.0), ("avg_waiting_time", 0.0), ("worker_error", True),
                ("error", "no evaluation result"),
            )
        ]
    )
    return joined.select(
        *KEYS, "individual_id", "genes",
        F.when(lost, float("inf")).otherwise(F.col("loss")).alias("loss"),
        F.when(lost, failed).otherwise(F.col("metrics")).alias("metrics"),
    )


def _store(df: DataFrame, path: str) -> DataFrame:
    """Write the folder anew: whatever an attempt that stopped has left there does not count."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store_population(pop: DataFrame, path: str, number: int) -> tuple[DataFrame, Progress]:
    """Write a generation and gather its figures in the same job."""
    seen = Observation()
    figures = [
        F.count(F.lit(1)).alias("members"), F.min("loss").alias("best_loss"),
        F.count_if(F.coalesce(F.col("metrics.worker_error"), F.lit(False))).alias("failed"),
    ]
    stored = _store(pop.observe(seen, *figures), path)
    got = seen.get
    return stored, Progress(number, got["members"], got["best_loss"], got["failed"])


IMMIGRANT_RATE = 0.03


def evolve_step(
    pop: DataFrame, runs: DataFrame, evaluate: Evaluate, seed: int = 42, population_size: int = 50,
    crossover_rate: float = 0.7, indpb: float = 0.3, elitism: int = 2, immigrant_rate: float = IMMIGRANT_RATE,
    elite_pct: float = 0.1, magnitude_weight: float = 0.001, assortative: bool = True, crowding: bool = True,
    stage: str | None = None, store: EvaluationStore | None = None,
) -> DataFrame:
    """One generation: parents, mating, mutation, evaluation of what changed, replacement. The caller stores the result.

    ``runs``: run_id, genome_size, lower_bound, upper_bound, sigma, rate (the last two may be boosted per run).
    """
    stage = stage or scratch_path(pop.sparkSession, "generation")
    name = stage.rsplit("/", 1)[-1]
    scores = P.parent_scores(pop, elite_pct, magnitude_weight)
    parents = _store(P.tournament(scores, seed=seed), f"{stage}/parents")
    crossed = P.crossover(P.mate_pairs(parents, assortative), crossover_rate, seed).select(
        *KEYS, "child_id", F.col("genes").alias("new_genes"), "crossed"
    )
    mixed = parents.join(crossed, [*KEYS, "child_id"], "left").select(
        *KEYS, "child_id", F.coalesce("new_genes", "genes").alias("genes"), "loss", "metrics",
        F.coalesce("crossed", F.lit(False)).alias("crossed"),
    )
    settings = runs.select("run_id", "sigma", "rate", "lower_bound")
    moved = P.mutate(
        mixed.join(settings, "run_id"), F.col("rate"), F.col("sigma"), indpb, F.col("lower_bound"), seed
    ).select(
        *KEYS, F.col("child_id").alias("individual_id"), "genes", "loss", "metrics",
        (F.col("crossed") | F.col("mutated")).alias("changed"),
    )
    children = _store(moved, f"{stage}/children")
    evaluated = evaluate_members(children.where("changed"), evaluate, store, f"{name}-offspring").select(*MEMBER)
    offspring = _store(children.where("not changed").select(*MEMBER).unionByName(evaluated), f"{stage}/offspring")
    n_immigrants = max(0, int(population_size * immigrant_rate))
    immigrants = None
    if n_immigrants:
        generation = pop.select(*KEYS).distinct()
        wanted = generation.join(runs.select("run_id", "genome_size", "lower_bound", "upper_bound"), "run_id").select(
            *KEYS, F.lit(n_immigrants).alias("n"), "genome_size", "lower_bound", "upper_bound",
            F.lit(None).cast("double").alias("activation"),
        )
        drawn = P.random_candidates(wanted, seed, "immigrant")
        immigrants = _store(evaluate_members(drawn, evaluate, store, f"{name}-immigrants"), f"{stage}/immigrants")
    following = P.replace_population(pop, offspring, immigrants, elitism, crowding, population_size)
    return following.withColumn("generation", F.col("generation") + 1)


def evolve(
    runs: DataFrame, evaluate: Evaluate, generations: int, population_size: int = 50, seed: int = 42,
    patience: int = 20, boost: float = 1.5, epsilon: float = 0.1, sigma: float = 20.0, rate: float = 0.5,
    on_generation: Callable[[DataFrame, Progress], None] | None = None, root: str | None = None,
    diversity_pairs: int | None = P.DIVERSITY_PAIRS, **step_options,
) -> tuple[DataFrame, DataFrame]:
    """Run the whole search for all rows of ``runs`` (run_id, genome_size, lower_bound, upper_bound, activation).

    Returns (all populations, generation statistics). Only the loop counter lives on the driver. ``on_generation`` gets each
    stored population and its figures; its errors are swallowed. A ``root`` that holds committed generations of a search
    with the same settings is gone on with; with other settings it is an error. The statistics take the genotypic diversity
    of ``diversity_pairs`` pairs of a population, None for all.
    """
    spark = runs.sparkSession
    root = root or scratch_path(spark, "search")
    settings = {
        "population_size": population_size, "seed": seed, "patience": patience, "boost": boost, "epsilon": epsilon,
        "sigma": sigma, "rate": rate, "diversity_pairs": diversity_pairs, **step_options,
    }
    record = json.dumps(settings, sort_keys=True)
    immigrants = max(0, int(population_size * step_options.get("immigrant_rate", IMMIGRANT_RATE)))
    store = EvaluationStore(spark, f"{root}/evaluations")

    def folder(number: int, table: str) -> str:
        return f"{root}/g{number}/{table}"

    def commit(number: int) -> None:
        spark.createDataFrame([(number, record)], "generation int, settings string").coalesce(1).write.mode("overwrite").parquet(folder(number, "commit"))

    def tell(pop: DataFrame, progress: Progress) -> None:
        if on_generation is not None:
            try:
                on_generation(pop, progress)
            except Exception:  # noqa: BLE001 - a reporting callback must not stop the search
                pass

    last = -1
    while last < generations and holds_results(spark, folder(last + 1, "commit")):
        last += 1
        if spark.read.parquet(folder(last, "commit")).first()["settings"] != record:
            raise ValueError(f"{root} holds a search with other settings")
        store.remember(f"g{last}-start" if last == 0 else f"g{last}-offspring")
        if last and immigrants:
            store.remember(f"g{last}-immigrants")
    if last < 0:
        start = runs.select(
            "run_id", F.lit(0).alias("generation"), F.lit(population_size).alias("n"), "genome_size", "lower_bound",
            "upper_bound", "activation",
        )
        first = evaluate_members(P.random_candidates(start, seed), evaluate, store, "g0-start")
        pop, progress = _store_population(first, folder(0, "population"), 0)
        commit(0)
        tell(pop, progress)
        last = 0
    else:
        pop = spark.read.parquet(folder(last, "population"))

    def statistics(upto: int) -> DataFrame | None:
        return spark.read.parquet(*[folder(k, "stats") for k in range(1, upto + 1)]) if upto else None

    stats = statistics(last)
    for number in range(last + 1, generations + 1):
        if stats is None:
            upcoming = runs.withColumn("sigma", F.lit(float(sigma))).withColumn("rate", F.lit(float(rate)))
            boosts = runs.select("run_id", F.lit(False).alias("boosted"))
        else:
            # The state after the last generation decides the mutation of the next one.
            series = stats.select("run_id", "generation", "best_loss").unionByName(
                runs.select("run_id", F.lit(number).alias("generation"), F.lit(float("inf")).alias("best_loss"))
            )
            state = P.stagnation(series, patience, boost, epsilon, sigma, rate).where(F.col("generation") == number)
            upcoming = runs.join(state.select("run_id", "sigma", "rate"), "run_id")
            boosts = state.select("run_id", "boosted")
        following = evolve_step(
            pop, upcoming, evaluate, seed + number, population_size, stage=f"{root}/g{number}", store=store, **step_options
        )
        pop, progress = _store_population(following, folder(number, "population"), number)
        flags = boosts.withColumn("generation", F.lit(number))
        _store(P.generation_stats(pop, flags, diversity_pairs=diversity_pairs), folder(number, "stats"))
        commit(number)
        stats = statistics(number)
        tell(pop, progress)
    history = spark.read.parquet(*[folder(k, "population") for k in range(generations + 1)])
    return history, stats
