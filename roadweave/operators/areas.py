"""Rows derived from area boxes: covering tiles and sampling points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions import geo

BOX = ("west", "south", "east", "north")


def bbox_tiles(areas: DataFrame, zoom: int) -> DataFrame:
    """One row per tile that covers the box of an area, x-major."""
    west, south, east, north = (F.col(c) for c in BOX)
    z = F.lit(zoom)
    x1, x2 = geo.tile_x(west, z), geo.tile_x(east, z)
    y1, y2 = geo.tile_y(south, z), geo.tile_y(north, z)
    keep = areas.columns
    ranged = areas.select(
        *keep, F.least(y1, y2).alias("_y1"), F.greatest(y1, y2).alias("_y2"),
        F.explode(F.sequence(F.least(x1, x2), F.greatest(x1, x2))).alias("x"),
    )
    return ranged.select(*keep, "x", F.explode(F.sequence("_y1", "_y2")).alias("y"))


def bbox_grid_points(areas: DataFrame, size: int | None = None) -> DataFrame:
    """Sampling points (i, j, lat, lon), south to north then west to east, borders included."""
    west, south, east, north = (F.col(c) for c in BOX)
    n = geo.grid_size(west, south, east, north) if size is None else F.lit(size)
    keep = areas.columns
    rows = areas.withColumn("_n", n)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("j"))

    def place(low, high, step: str):
        share = F.col(step) / (F.col("_n") - 1)
        return F.when(F.col("_n") > 1, low + (high - low) * share).otherwise((low + high) / 2)

    return rows.select(*keep, "i", "j", place(south, north, "i").alias("lat"), place(west, east, "j").alias("lon"))
