"""Preparation of many areas in one plan: observations to matched edges, quality and the go/no-go gate."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators import cleaning, matching, quality

Provider = Callable[[SparkSession, DataFrame], DataFrame]

_PROVIDERS: dict[str, Provider] = {}
_REQUIRED = ("area_id", "segment_id", "geometry", "current_speed", "freeflow_speed", "timestamp", "quality")


def register_provider(name: str, fetch: Provider) -> None:
    """Make ``fetch(spark, areas) -> traffic segments`` available under a name."""
    if not name.strip():
        raise ValueError("a provider needs a name")
    _PROVIDERS[name] = fetch


def providers() -> list[str]:
    return sorted(_PROVIDERS)


def fetch_segments(name: str, spark: SparkSession, areas: DataFrame) -> DataFrame:
    """Segments of a registered provider; the schema of the result is checked."""
    segments = _PROVIDERS[name](spark, areas)
    missing = [c for c in _REQUIRED if c not in segments.columns]
    if missing:
        raise ValueError(f"provider {name} lacks columns: {', '.join(missing)}")
    return segments


class Prepared(NamedTuple):
    segments: DataFrame
    observed: DataFrame
    edges: DataFrame
    links: DataFrame
    quality: DataFrame
    passed: DataFrame


def prepare(
    segments: DataFrame, lanes: DataFrame, connections: DataFrame, locations: DataFrame, areas: DataFrame,
    order: list[str], min_score: int = 0, allowed: tuple[str, ...] | None = None,
) -> Prepared:
    """Clip and deduplicate segments, build the network, match, assess and gate every area. Nothing runs yet."""
    kept = cleaning.dedup_segments(cleaning.clip_to_bbox(segments, areas), ["area_id"], order)
    edges = matching.build_edges(lanes)
    links = matching.build_links(connections, lanes)
    zones = matching.network_locations(locations, areas)
    observed = matching.match_segments(matching.project_segments(kept, zones), edges)
    assessed = quality.assess_quality(kept, observed, edges, areas)
    return Prepared(kept, observed, edges, links, assessed, quality.gate(assessed, min_score, allowed))


def pending(genomes: DataFrame) -> DataFrame:
    """Candidates that still need an evaluation: only rows without a loss."""
    return genomes.where(F.col("loss").isNull())
