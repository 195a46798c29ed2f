"""Dataset catalogs: union, listing, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUBLIC = ("id", "name", "source", "west", "south", "east", "north", "created_at", "quality_label", "quality_score")


def union_catalogs(generated: DataFrame, packaged: DataFrame) -> DataFrame:
    """Both catalogs, copies of the same name kept, each row tagged with its source."""

    def tagged(df: DataFrame, source: str) -> DataFrame:
        return df.withColumn("source", F.lit(source)).withColumn("id", F.concat(F.lit(f"{source}:"), "name"))

    return tagged(generated, "generated").unionByName(tagged(packaged, "packaged"))


def catalog_listing(catalog: DataFrame) -> DataFrame:
    """Public fields ordered by name and source."""
    return catalog.select(*[c for c in PUBLIC if c in catalog.columns]).orderBy("name", "source")


def resolve_datasets(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each ``ref`` by id (``source:name``) or by unique name: ``ok``, ``not_found``, ``ambiguous`` or ``required``."""
    wanted = refs.select("ref").distinct().withColumn("_key", F.trim("ref"))
    # One key column for both ways of naming: an id contains a colon, a valid name does not.
    by_key = (
        catalog.select(F.explode(F.array("id", "name")).alias("_key"), "id")
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dataset_id"))
    )
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    blank = F.coalesce(F.col("_key"), F.lit("")) == ""
    return wanted.join(by_key, "_key", "left").select(
        "ref",
        F.when(blank, "required").when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("ok").alias("status"),
        F.when(n == 1, F.col("dataset_id")).alias("dataset_id"),
        n.alias("n_matches"),
    )


def existing_names(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested names that some catalog already holds."""
    wanted = names.select(F.trim("name").alias("name")).distinct()
    return wanted.join(catalog.select("name"), "name", "left_semi")
