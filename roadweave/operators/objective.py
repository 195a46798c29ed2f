"""Observed against simulated speeds: joins, loss components, fit, and one record per evaluated candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions import observe, scoring

INF = float("inf")


def with_freeflow_default(observed: DataFrame) -> DataFrame:
    """The default applies only where the column itself is absent; a null value stays null."""
    if "freeflow_speed" in observed.columns:
        return observed
    return observed.withColumn("freeflow_speed", F.lit(observe.DEFAULT_FREEFLOW_KMH))


def mean_edge_speeds(intervals: DataFrame, warmup: float) -> DataFrame:
    """Plain mean speed per scenario and edge over the intervals that begin after the warm-up."""
    keys = [c for c in ("area_id", "scenario_id") if c in intervals.columns]
    return (
        intervals.where(F.col("begin") >= warmup)
        .select(*keys, "edge_id", observe.speed_kmh(F.col("speed")).alias("kmh"))
        .where(F.col("kmh").isNotNull())
        .groupBy(*keys, "edge_id")
        .agg(F.avg("kmh").alias("speed_kmh"))
    )


def interval_coverage(intervals: DataFrame, warmup: float) -> DataFrame:
    """Interval and edge counts before and after the warm-up per scenario."""
    # One row per interval and edge first: the distinct counts then work on far fewer rows.
    early = F.col("begin") < warmup
    edges = (
        intervals.groupBy("scenario_id", "edge_id")
        .agg(
            F.bool_or(early & observe.has_speed(F.col("speed"))).alias("early"),
            F.bool_or(~early & observe.has_speed(F.col("speed"))).alias("late"),
        )
        .groupBy("scenario_id")
        .agg(F.count_if("early").alias("edges_in_warmup"), F.count_if("late").alias("edges_in_measurement"))
    )
    spans = (
        intervals.select("scenario_id", "begin", "end")
        .distinct()
        .groupBy("scenario_id")
        .agg(
            F.count(F.lit(1)).alias("total_intervals"),
            F.count_if(early).alias("warmup_intervals"),
            F.count_if(~early).alias("measurement_intervals"),
        )
    )
    return spans.join(edges, "scenario_id").withColumn(
        "only_in_warmup", (F.col("edges_in_measurement") == 0) & (F.col("edges_in_warmup") > 0)
    )


def trip_stats(tripinfo: DataFrame, statistics: DataFrame | None, expected: DataFrame) -> DataFrame:
    """Trip statistics per expected scenario; simulator totals override the counts where they exist."""
    done = tripinfo.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("completed_trips"),
        F.avg("duration").alias("avg_duration"),
        F.avg("waiting").alias("avg_waiting_time"),
    )
    zero = F.lit(0).cast("bigint")
    base = expected.join(done, "scenario_id", "left").select(
        "scenario_id",
        "expected_vehicles",
        F.coalesce("completed_trips", zero).alias("completed_trips"),
        F.coalesce("avg_duration", F.lit(0.0)).alias("avg_duration"),
        F.coalesce("avg_waiting_time", F.lit(0.0)).alias("avg_waiting_time"),
    )
    failures = F.when(
        F.col("expected_vehicles").isNotNull(),
        F.greatest(zero, F.col("expected_vehicles") - F.col("completed_trips")),
    ).otherwise(zero)
    total = F.coalesce("expected_vehicles", "completed_trips")
    if statistics is None:
        return base.withColumn("routing_failures", failures).withColumn("teleports", zero).withColumn(
            "total_trips", total
        )
    stated = F.coalesce(F.col("loaded") > 0, F.lit(False))
    return base.join(
        statistics.select("scenario_id", "loaded", "inserted", F.col("teleports").alias("_teleports")),
        "scenario_id", "left",
    ).select(
        "scenario_id", "expected_vehicles", "completed_trips", "avg_duration", "avg_waiting_time",
        F.when(stated, F.col("loaded") - F.col("inserted")).otherwise(failures).cast("bigint").alias("routing_failures"),
        F.when(stated, F.col("_teleports")).otherwise(zero).cast("bigint").alias("teleports"),
        F.when(stated, F.col("loaded")).otherwise(total).cast("bigint").alias("total_trips"),
    )


def join_observed_simulated(observed: DataFrame, simulated: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every observed row of an area for each of its scenarios, with the simulated speed where there is one.

    This is the row-level form, whose output is the product by definition; the aggregates below avoid it.
    """
    observed = with_freeflow_default(observed)
    grid = scenarios.select("area_id", "scenario_id").join(observed, "area_id")
    sim = simulated.select("scenario_id", "edge_id", F.col("speed_kmh").alias("simulated_speed"))
    joined = grid.join(sim, ["scenario_id", "edge_id"], "left")
    return joined.withColumn("missing", F.col("simulated_speed").isNull()).withColumn(
        "effective_speed", F.coalesce("simulated_speed", "freeflow_speed")
    )


def missing_edges(observed: DataFrame, simulated: DataFrame, scenarios: DataFrame) -> DataFrame:
    grid = scenarios.select("area_id", "scenario_id").join(observed.select("area_id", "edge_id").distinct(), "area_id")
    return grid.join(simulated, ["scenario_id", "edge_id"], "left_anti").select("scenario_id", "edge_id")


def covered_edges(observed: DataFrame, simulated: DataFrame) -> DataFrame:
    """Observed edges that appear in a scenario: a semi join, no product needed."""
    return simulated.select("area_id", "scenario_id", "edge_id").join(
        observed.select("area_id", "edge_id"), ["area_id", "edge_id"], "left_semi"
    ).select("scenario_id", "edge_id").distinct()


def common_edges(observed: DataFrame, simulated: DataFrame) -> DataFrame:
    return observed.select("area_id", "edge_id").intersect(simulated.select("area_id", "edge_id"))


def uncovered_edges(observed: DataFrame, simulated: DataFrame) -> DataFrame:
    missing = observed.select("area_id", "edge_id").subtract(simulated.select("area_id", "edge_id"))
    return missing.orderBy("area_id", "edge_id")


#: Values below this in size are summed exactly, to twelve digits behind the point.
EXACT_LIMIT = 1e15


def exact_sum(value: Column, name: str) -> list[Column]:
    """Aggregates whose total does not depend on the order of the rows: decimals, and what is too large for them as doubles."""
    small = F.abs(value) < EXACT_LIMIT
    return [
        F.coalesce(F.sum(F.when(small, value).cast("decimal(28,12)")), F.lit(0).cast("decimal(38,12)")).alias(name),
        F.coalesce(F.sum(F.when(~small, value)), F.lit(0.0)).alias(f"{name}_large"),
    ]


def error_sums(observed: DataFrame, simulated: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Error sums per scenario without building scenario x observed rows.

    A missing edge counts as free flow in every scenario, so the sum over all observed rows is known per area
    once; matched rows then replace their free-flow term by their simulated one. The sums are exact, so neither the
    difference nor the order of the rows leaves a rounding error.
    """
    observed = with_freeflow_default(observed)
    free = F.col("freeflow_speed") - F.col("current_speed")
    sim = F.col("speed_kmh") - F.col("current_speed")

    def sums(error, prefix: str):
        return [
            *exact_sum(F.abs(error), f"{prefix}_abs"),
            *exact_sum(error * error, f"{prefix}_sq"),
            *exact_sum(error, f"{prefix}_sum"),
            F.count_if(error.isNull()).alias(f"{prefix}_unknown"),
        ]

    base = observed.groupBy("area_id").agg(F.count(F.lit(1)).alias("total_edges"), *sums(free, "area"))
    matched = (
        simulated.select("area_id", "scenario_id", "edge_id", "speed_kmh")
        .join(observed.select("area_id", "edge_id", "current_speed", "freeflow_speed"), ["area_id", "edge_id"])
        .groupBy("scenario_id")
        .agg(F.count(F.lit(1)).alias("matched_edges"), *sums(free, "free"), *sums(sim, "sim"))
    )
    joined = scenarios.select("area_id", "scenario_id").join(base, "area_id", "left").join(matched, "scenario_id", "left")
    zero = F.lit(0).cast("bigint")
    total, hit = F.coalesce("total_edges", zero), F.coalesce("matched_edges", zero)

    def combined(name: str):
        exact = [F.coalesce(F.col(f"{p}_{name}"), F.lit(0).cast("decimal(38,12)")) for p in ("area", "free", "sim")]
        large = [F.coalesce(F.col(f"{p}_{name}_large"), F.lit(0.0)) for p in ("area", "free", "sim")]
        # Nothing left over: avoid the rounding residue of a difference of equal sums.
        rest = F.when(hit == total, 0.0).otherwise(large[0] - large[1])
        return (exact[0] - exact[1] + exact[2]).cast("double") + rest + large[2]

    unknown = (
        F.coalesce("area_unknown", zero) - F.coalesce("free_unknown", zero) + F.coalesce("sim_unknown", zero)
    )
    nan = float("nan")
    return joined.select(
        "area_id",
        "scenario_id",
        total.alias("total_edges"),
        hit.alias("matched_edges"),
        (total - hit).alias("missing_edges"),
        # One unknown speed makes every mean of the scenario unknown.
        F.when(unknown > 0, nan).otherwise(F.greatest(F.lit(0.0), combined("abs"))).alias("abs_sum"),
        F.when(unknown > 0, nan).otherwise(F.greatest(F.lit(0.0), combined("sq"))).alias("sq_sum"),
        F.when(unknown > 0, nan).otherwise(combined("sum")).alias("diff_sum"),
    )


def loss_components(
    observed: DataFrame, simulated: DataFrame, scenarios: DataFrame, trips: DataFrame, expected: DataFrame
) -> DataFrame:
    """mae, coverage penalty, e_loss, failures, reliability penalty and loss per scenario."""
    counts = trips.select("scenario_id", "routing_failures", "teleports")
    joined = (
        error_sums(observed, simulated, scenarios)
        .join(counts, "scenario_id", "left")
        .join(expected.select("scenario_id", "expected_vehicles"), "scenario_id", "left")
    )
    return _with_losses(joined).select(
        "area_id", "scenario_id", "mae", "coverage_penalty", "e_loss", "fail_total", "reliability_penalty", "loss",
        "missing_edges",
    )


def _with_losses(joined: DataFrame) -> DataFrame:
    """Loss columns added to error sums with the trip counts of their scenario."""
    some = F.col("total_edges") > 0
    failed = scoring.fail_total(F.col("routing_failures"), F.col("teleports"))
    penalty = F.when(
        some, scoring.reliability_penalty(failed, F.coalesce("expected_vehicles", F.lit(0)))
    ).otherwise(0.0)
    return (
        joined.withColumn("mae", F.when(some, F.col("abs_sum") / F.col("total_edges")).otherwise(INF))
        .withColumn(
            "coverage_penalty",
            F.when(
                F.col("missing_edges") > 0, F.col("missing_edges") / F.col("total_edges") * scoring.COVERAGE_SCALE
            ).otherwise(0.0),
        )
        .withColumn("e_loss", F.col("mae") + F.col("coverage_penalty"))
        .withColumn("fail_total", failed)
        .withColumn("reliability_penalty", penalty)
        .withColumn("loss", F.col("e_loss") + F.col("reliability_penalty"))
    )


def _mse() -> Column:
    return F.when(F.col("total_edges") > 0, F.col("sq_sum") / F.col("total_edges")).otherwise(INF)


def _avg_speed_diff() -> Column:
    return F.when(F.col("total_edges") > 0, F.col("diff_sum") / F.col("total_edges")).otherwise(0.0)


def speed_metrics(observed: DataFrame, simulated: DataFrame, scenarios: DataFrame) -> DataFrame:
    n = F.col("total_edges")
    return error_sums(observed, simulated, scenarios).select(
        "area_id",
        "scenario_id",
        F.when(n > 0, F.col("abs_sum") / n).otherwise(INF).alias("mae"),
        _mse().alias("mse"),
        "matched_edges",
        "missing_edges",
        F.col("missing_edges").alias("zero_flow_edges"),
        "total_edges",
        _avg_speed_diff().alias("avg_speed_diff"),
    )


def fit_stats(observed: DataFrame, simulated: DataFrame, scenarios: DataFrame) -> DataFrame:
    """R2, RMSE and MAE over matched pairs; null below two pairs."""
    error = F.col("speed_kmh") - F.col("current_speed")
    pairs = (
        simulated.select("area_id", "scenario_id", "edge_id", "speed_kmh")
        .join(observed.select("area_id", "edge_id", "current_speed"), ["area_id", "edge_id"])
        .groupBy("scenario_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(error * error).alias("res"),
            F.sum(F.abs(error)).alias("abs"),
            F.var_pop("current_speed").alias("var"),
        )
    )
    enough = F.col("n") >= 2
    spread = F.col("var") * F.col("n")
    return scenarios.select("scenario_id").join(pairs, "scenario_id", "left").select(
        "scenario_id",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n_matched"),
        F.when(enough, F.when(spread > 0, F.lit(1.0) - F.col("res") / spread).otherwise(0.0)).alias("r_squared"),
        F.when(enough, F.sqrt(F.col("res") / F.col("n"))).alias("rmse"),
        F.when(enough, F.col("abs") / F.col("n")).alias("mae"),
    )


def magnitude(genomes: DataFrame) -> DataFrame:
    """Genome sum = expected vehicles."""
    total = F.aggregate("genes", F.lit(0).cast("bigint"), lambda acc, g: acc + g)
    return genomes.withColumn("magnitude", total)


def evaluate_scenarios(
    genomes: DataFrame, observed: DataFrame, simulated: DataFrame, tripinfo: DataFrame, statistics: DataFrame
) -> DataFrame:
    """One record per candidate; a candidate without any simulation output gets the failure sentinel."""
    candidates = magnitude(genomes).select("area_id", "scenario_id", F.col("magnitude").alias("expected_vehicles"))
    expected = candidates.select("scenario_id", "expected_vehicles")
    trips = trip_stats(tripinfo, statistics, expected)
    scenarios = candidates.select("area_id", "scenario_id")
    ran = (
        simulated.select("scenario_id")
        .union(statistics.select("scenario_id"))
        .distinct()
        .withColumn("ran", F.lit(True))
    )
    joined = (
        _with_losses(error_sums(observed, simulated, scenarios).join(trips, "scenario_id"))
        .withColumn("mse", _mse())
        .withColumn("avg_speed_diff", _avg_speed_diff())
        .withColumn("zero_flow_edges", F.col("missing_edges"))
        .join(ran, "scenario_id", "left")
    )
    # A scenario with completed trips has run even without any other output.
    ok = F.coalesce("ran", F.col("completed_trips") > 0)
    sentinel = F.lit(scoring.FAILED_EVALUATION_FAIL_TOTAL).cast("bigint")

    def unless_failed(name: str, failed):
        return F.when(ok, F.col(name)).otherwise(failed)

    nothing = F.lit(None)
    return joined.select(
        "scenario_id",
        unless_failed("loss", INF).alias("loss"),
        unless_failed("e_loss", INF).alias("e_loss"),
        unless_failed("reliability_penalty", INF).alias("reliability_penalty"),
        unless_failed("mae", nothing).alias("mae"),
        unless_failed("mse", nothing).alias("mse"),
        unless_failed("matched_edges", nothing).alias("matched_edges"),
        unless_failed("zero_flow_edges", nothing).alias("zero_flow_edges"),
        unless_failed("total_edges", nothing).alias("total_edges"),
        unless_failed("avg_speed_diff", nothing).alias("avg_speed_diff"),
        unless_failed("routing_failures", sentinel).alias("routing_failures"),
        unless_failed("teleports", F.lit(0).cast("bigint")).alias("teleports"),
        unless_failed("fail_total", sentinel).alias("fail_total"),
        unless_failed("expected_vehicles", F.lit(0).cast("bigint")).alias("total_vehicles"),
        unless_failed("avg_duration", 0.0).alias("avg_trip_duration"),
        unless_failed("avg_waiting_time", 0.0).alias("avg_waiting_time"),
        (~ok).alias("worker_error"),
        F.when(~ok, "no simulation output").alias("error"),
    )
