"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadweave.operators.graph import star_components
from roadweave.session import Scratch


def connected(links: DataFrame, scratch: Scratch | None = None, name: str = "stars") -> DataFrame:
    """(node, component) of every node that occurs in ``links`` (a, b); the component is its smallest node."""
    return star_components(links.select("a", "b"), [], scratch, name)
