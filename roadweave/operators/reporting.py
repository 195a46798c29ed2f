"""Comparison tables, series and run records behind reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.functions import observe, scoring
from roadweave.operators.objective import join_observed_simulated
from roadweave.operators.ordering import explode_range, number_rows

# Shipped run defaults.
RUN_DEFAULTS = {
    "window_minutes": 15,
    "seed": 42,
    "warmup_minutes": 5,
    "step_length": 1.0,
    "traffic_tile_zoom": 12,
    "ga_population": 50,
    "ga_generations": 20,
    "ga_elitism": 2,
    "ga_mutation_rate": 0.5,
    "ga_crossover_rate": 0.7,
    "initial_population": 1000,
    "num_origins": 10,
    "num_destinations": 10,
    "max_od_pairs": 50,
    "bin_minutes": 5,
    "ga_mutation_sigma": 20,
    "ga_mutation_indpb": 0.3,
    "ga_immigrant_rate": 0.03,
    "ga_elite_top_pct": 0.1,
    "ga_magnitude_penalty_weight": 0.001,
    "ga_stagnation_patience": 20,
    "ga_stagnation_boost": 1.5,
    "ga_checkpoint_interval": 10,
    "ga_assortative_mating": True,
    "ga_deterministic_crowding": True,
}


def speed_comparison(observed: DataFrame, simulated: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every observed row per scenario with its simulated speed and status."""
    joined = join_observed_simulated(observed, simulated, scenarios)
    return joined.select(
        "scenario_id",
        "edge_id",
        F.col("current_speed").alias("observed_speed"),
        "simulated_speed",
        F.when(F.col("missing"), "missing_in_sim").otherwise("matched").alias("status"),
    )


def top_mismatches(observed: DataFrame, simulated: DataFrame, scenarios: DataFrame, n: int = 10) -> DataFrame:
    """Edges with the largest rounded error per scenario; the rank limit is applied before the shuffle.

    The observed speed is the error of a missing edge in every scenario, so an area's rows are ranked by it once. A scenario
    with m simulated rows finds its n largest missing ones among the first n + m of that rank: it reads those and its
    own m rows, never all rows of the area.
    """
    known = observed.select("area_id", "edge_id", "segment_id", "current_speed").where("current_speed is not null")
    ran = simulated.select("scenario_id", "edge_id", F.col("speed_kmh").alias("simulated_speed")).where("speed_kmh is not null")
    matched = scenarios.select("area_id", "scenario_id").join(ran, "scenario_id").join(known, ["area_id", "edge_id"])
    worst_first = [F.desc(F.bround("current_speed", 1)), "edge_id", "segment_id"]
    ranked = number_rows(known, ["area_id"], worst_first, "_place").withColumn("_rank", F.col("_place") + 1).drop("_place")
    reads = scenarios.select("area_id", "scenario_id").join(
        matched.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("_m")), "scenario_id", "left"
    ).withColumn("_reads", F.coalesce("_m", F.lit(0)) + n)
    size = known.groupBy("area_id").agg(F.count(F.lit(1)).alias("_size"))
    wanted = explode_range(reads.join(size, "area_id").withColumn("_reads", F.least("_reads", "_size")), "_reads", "_rank")
    missing = (
        wanted.select("area_id", "scenario_id", "_rank").join(ranked, ["area_id", "_rank"])
        .join(ran.select("scenario_id", "edge_id").distinct(), ["scenario_id", "edge_id"], "left_anti")
    )
    columns = ["scenario_id", "edge_id", "segment_id", "current_speed"]
    both = missing.select(*columns, F.lit(None).cast("double").alias("simulated_speed")).unionByName(
        matched.select(*columns, "simulated_speed")
    )
    gone = F.col("simulated_speed").isNull()
    error = F.when(gone, F.col("current_speed")).otherwise(F.abs(F.col("simulated_speed") - F.col("current_speed")))
    rows = both.select(
        "scenario_id",
        "edge_id",
        "segment_id",
        F.bround("current_speed", 1).alias("observed"),
        F.bround(F.coalesce("simulated_speed", F.lit(0.0)), 1).alias("simulated"),
        F.bround(error, 1).alias("error"),
        F.when(gone, "(No Traffic)").otherwise("").alias("note"),
    )
    worst = W.partitionBy("scenario_id").orderBy(F.desc("error"), "edge_id", "segment_id")
    return (
        rows.withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= n).drop("segment_id")
    )


def convergence_series(stats: DataFrame) -> DataFrame:
    return stats.select(
        "run_id", "generation", "best_loss", "mean_loss",
        (F.col("mean_loss") - F.col("std_loss")).alias("lower"), (F.col("mean_loss") + F.col("std_loss")).alias("upper"),
    ).orderBy("run_id", "generation")


def failure_series(stats: DataFrame) -> DataFrame:
    def number(*names: str):
        return F.coalesce(*[F.col(n).cast("double") for n in names], F.lit(0.0))

    return stats.select(
        "run_id", "generation",
        number("best_zero_flow").alias("best_zero_flow"), number("mean_zero_flow").alias("mean_zero_flow"),
        number("best_fail_total", "best_routing_failures").alias("best_failures"),
        number("mean_fail_total", "mean_routing_failures").alias("mean_failures"),
    ).orderBy("run_id", "generation")


def population_series(stats: DataFrame) -> DataFrame:
    """Magnitude and diversity per generation; ``boosted_at`` marks boosted generations."""
    return stats.select(
        "run_id", "generation", "best_magnitude", "mean_magnitude", "genotypic_diversity", "phenotypic_diversity",
        F.when(F.col("mutation_boosted"), F.col("generation")).alias("boosted_at"),
    ).orderBy("run_id", "generation")


def optimization_result(best: DataFrame) -> DataFrame:
    """Published result of a search; values that are not finite become null."""
    return best.select(
        "run_id",
        "selected_mode",
        scoring.report_round(F.col("selected_value")).alias("selected_value"),
        F.when(F.col("selected_mode") == "feasible", "feasible flow-fit error E")
        .otherwise("raw objective loss")
        .alias("selected_value_label"),
        scoring.report_round(F.col("best_raw_loss")).alias("best_raw_loss"),
        scoring.report_round(F.col("best_feasible_e_loss")).alias("best_feasible_e_loss"),
    )


def run_parameters(raw: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Text overrides to one typed row per run; what is absent or unreadable falls back to the default."""
    values = RUN_DEFAULTS if defaults is None else defaults
    columns = []
    for name, default in values.items():
        given = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        if isinstance(default, bool):
            value = observe.as_bool(given, default)
        elif isinstance(default, int):
            value = F.coalesce(given.try_cast("int"), F.lit(default))
            if name == "ga_checkpoint_interval":
                value = F.greatest(F.lit(1), value)
        else:
            value = F.coalesce(given.try_cast("double"), F.lit(default))
        columns.append(value.alias(name))
    return raw.select("run_id", *columns)


def match_rate_percent(matched, total):
    return F.when(total > 0, F.bround(matched * 100.0 / total, 1)).otherwise(0.0)


def run_summary(
    params: DataFrame, metrics: DataFrame, result: DataFrame, history: DataFrame, areas: DataFrame
) -> DataFrame:
    """One nested record per run. ``params``: run_id, area_id and the run parameters; ``metrics``: run_id and the
    speed metrics; ``result``: optimization_result; ``history``: run_id, generation, best_loss."""
    ga = [c for c in params.columns if c.startswith("ga_")]
    # One entry per generation of a run: a bounded parameter of the run.
    losses = history.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("generation", F.bround("best_loss", 2).alias("loss")))).alias("_h")
    )
    joined = (
        params.join(areas.select("area_id", "west", "south", "east", "north"), "area_id")
        .join(metrics.drop("area_id", "scenario_id"), "run_id", "left")
        .join(result, "run_id", "left")
        .join(losses, "run_id", "left")
    )
    history_col = F.transform("_h", lambda h: h["loss"])
    usable = F.coalesce(F.col("_h")[0]["loss"] != float("inf"), F.lit(False))
    return joined.select(
        "run_id",
        F.struct(
            F.struct("west", "south", "east", "north").alias("bbox_coordinates"), "seed", F.lit("dynamic").alias("routing_mode")
        ).alias("run_info"),
        F.struct(
            "window_minutes", "warmup_minutes", F.col("step_length").alias("step_length_seconds"), "traffic_tile_zoom"
        ).alias("simulation_config"),
        F.struct(*ga).alias("calibration_config"),
        F.struct("num_origins", "num_destinations", "max_od_pairs", "bin_minutes", "initial_population").alias("demand_config"),
        F.struct(
            scoring.report_round(F.col("mae")).alias("final_loss_mae_kmh"),
            F.when(usable, history_col).otherwise(F.array().cast("array<double>")).alias("loss_history"),
            F.struct(
                "selected_mode", "selected_value", "selected_value_label", "best_raw_loss", "best_feasible_e_loss"
            ).alias("optimization_result"),
            F.struct(
                scoring.report_round(F.col("mae")).alias("mae_kmh"),
                scoring.report_round(F.col("mse")).alias("mse_kmh2"),
                "matched_edges", "missing_edges", F.col("total_edges").alias("total_observed_edges"),
                match_rate_percent(F.col("matched_edges"), F.col("total_edges")).alias("match_rate_percent"),
            ).alias("quality_metrics"),
        ).alias("results"),
    )
