"""Failure, feasibility, loss and data-quality scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of the failure rate, weight of the missing share, sentinel of a failed evaluation.
RELIABILITY_SCALE = 2000.0
COVERAGE_SCALE = 10.0
FAILED_EVALUATION_FAIL_TOTAL = 1

# Fixed values: (lower bound, points) ladders of the data-quality score, best first.
MATCHED_LADDER = ((40, 35), (25, 30), (15, 24), (8, 16), (5, 10), (1, 4))
RATE_LADDER = ((0.95, 25), (0.9, 22), (0.8, 18), (0.7, 14), (0.5, 8))
DENSITY_LADDER = ((10.0, 15), (6.0, 12), (3.0, 8), (1.5, 5))
COVERAGE_LADDER = ((0.03, 10), (0.02, 8), (0.01, 6), (0.005, 4))
# (median at least, low-confidence share at most, points)
CONFIDENCE_LADDER = ((0.99, 0.02, 15), (0.97, 0.1, 13), (0.94, 0.2, 10), (0.9, 1.0, 6))
LABEL_LADDER = ((85, "excellent"), (70, "good"), (55, "fair"), (40, "weak"))
LOW_CONFIDENCE = 0.85


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def fail_total(routing_failures: Column, teleports: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.coalesce(routing_failures.cast("bigint"), zero) + F.coalesce(teleports.cast("bigint"), zero)


def reliability_penalty(failures: Column, expected: Column) -> Column:
    return F.when((failures > 0) & (expected > 0), failures / expected * RELIABILITY_SCALE).otherwise(0.0)


def has_error(worker_error: Column, error: Column) -> Column:
    return F.coalesce(worker_error, F.lit(False)) | (F.coalesce(error, F.lit("")) != "")


def effective_fail_total(m: Column) -> Column:
    """Stated failures, else the sum of both kinds, else 1 for an evaluation that only reports an error."""
    routing, teleports = m["routing_failures"], m["teleports"]
    both = F.coalesce(routing.cast("bigint"), F.lit(0)) + F.coalesce(teleports.cast("bigint"), F.lit(0))
    silent = (both == 0) & routing.isNull() & teleports.isNull() & has_error(m["worker_error"], m["error"])
    return F.coalesce(
        m["fail_total"].cast("bigint"), F.when(silent, F.lit(FAILED_EVALUATION_FAIL_TOTAL)).otherwise(both)
    )


def is_feasible(loss: Column, m: Column) -> Column:
    return is_finite(loss) & ~has_error(m["worker_error"], m["error"]) & (effective_fail_total(m) == 0)


def effective_e_loss(loss: Column, m: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(has_error(m["worker_error"], m["error"]), inf).otherwise(F.coalesce(m["e_loss"], loss, inf))


def effective_penalty(loss: Column, m: Column) -> Column:
    e_loss = effective_e_loss(loss, m)
    implied = F.when(is_finite(loss) & is_finite(e_loss), F.greatest(F.lit(0.0), loss - e_loss)).otherwise(0.0)
    return F.when(has_error(m["worker_error"], m["error"]), float("inf")).otherwise(
        F.coalesce(m["reliability_penalty"], implied)
    )


def report_round(value: Column, digits: int = 2) -> Column:
    """Half-even on the decimal text; null if not finite. What lies behind nine digits is noise of the sums and goes first,
    so that a mean that ends in 5 is the same tie whatever order its terms came in."""
    return F.when(is_finite(value), F.bround(F.bround(value, 9), digits))


def _ladder(value: Column, steps, rest: Column | int | str) -> Column:
    rest = rest if isinstance(rest, Column) else F.lit(rest)
    branches = None
    for bound, points in steps:
        branches = F.when(value >= bound, points) if branches is None else branches.when(value >= bound, points)
    return branches.otherwise(rest)


def matched_score(matched: Column) -> Column:
    return _ladder(matched, MATCHED_LADDER, 0)


def match_rate_score(rate: Column) -> Column:
    return _ladder(rate, RATE_LADDER, F.when(rate > 0, 3).otherwise(0))


def confidence_score(median: Column, low_share: Column) -> Column:
    score = F.when(median.isNull() | low_share.isNull(), 10)
    for lowest, most, points in CONFIDENCE_LADDER:
        score = score.when((median >= lowest) & (low_share <= most), points)
    return score.otherwise(2)


def density_score(edges_per_km2: Column) -> Column:
    ladder = _ladder(edges_per_km2, DENSITY_LADDER, F.when(edges_per_km2 > 0, 2).otherwise(0))
    return F.when(edges_per_km2.isNull(), 8).otherwise(ladder)


def coverage_score(ratio: Column) -> Column:
    return F.when(ratio.isNull(), 5).otherwise(
        _ladder(ratio, COVERAGE_LADDER, F.when(ratio > 0, 2).otherwise(0))
    )


def quality_label(score: Column) -> Column:
    return _ladder(score, LABEL_LADDER, "poor")


def recommendation(score: Column, matched: Column) -> Column:
    return (
        F.when(matched == 0, "do_not_proceed")
        .when((matched < 5) | (score < 40), "high_risk")
        .when(score < 55, "caution")
        .otherwise("proceed")
    )


def quality_warnings(fetched, matched, match_rate, edges_per_km2, ratio, median) -> Column:
    """Names of the warnings that apply, in fixed order."""
    checks = F.array(
        F.when(fetched == 0, "no_traffic_segments"),
        F.when(matched == 0, "no_matched_edges").when(matched < 5, "very_few_matched_edges"),
        F.when(match_rate < 0.7, "low_match_rate"),
        F.when(edges_per_km2 < 1.5, "sparse_observed_edges"),
        F.when(ratio < 0.005, "low_network_coverage"),
        F.when(median < 0.94, "low_match_confidence"),
    )
    return F.filter(checks, lambda w: w.isNotNull())
