"""Writers for demand, trips, agents, comparison tables and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions import observe
from roadweave.operators.demand import index_agents, od_dictionary, order_trips


def write_demand_csv(trips: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted demand, one directory per scenario, with the exact four-column header."""
    order_trips(trips).select(
        "scenario_id",
        F.col("trip_id").alias("ID"),
        F.col("origin").alias("origin link id"),
        F.col("destination").alias("destination link id"),
        F.col("departure").alias("departure timestep"),
    ).write.mode(mode).partitionBy("scenario_id").option("header", True).csv(path)


def write_trips_xml(trips: DataFrame, path: str, mode: str = "error", folders: bool = True) -> None:
    """``routes/trip`` files in departure order, one directory per scenario, or with ``folders`` off files that scenarios share,
    with scenario_id as an attribute."""
    rows = order_trips(trips).select(
        F.col("scenario_id").alias("scenario_id" if folders else "_scenario_id"),
        F.col("trip_id").alias("_id"),
        observe.format_departure(F.col("departure")).alias("_depart"),
        F.col("origin").alias("_from"),
        F.col("destination").alias("_to"),
    )
    writer = rows.write.format("xml").mode(mode).option("rootTag", "routes").option("rowTag", "trip")
    (writer.partitionBy("scenario_id") if folders else writer).save(path)


def write_agents(trips: DataFrame, path: str, mode: str = "error") -> None:
    """Agents as CSV and the index dictionaries as JSON, both split by run.

    Range partitions keep the rows of a run together, and a large run in several files.
    """
    index_agents(trips).repartitionByRange("run_id", "id").write.mode(mode).partitionBy("run_id").option("header", True).csv(f"{path}/agents")
    od_dictionary(trips).orderBy("run_id", "role", "idx").write.mode(mode).partitionBy("run_id").json(f"{path}/od")


def write_speed_comparison(comparison: DataFrame, path: str, mode: str = "error", folders: bool = True) -> None:
    """One directory per scenario, or with ``folders`` off files that scenarios share, with scenario_id as the last column."""
    rows = comparison.repartitionByRange("scenario_id", "edge_id")
    if folders:
        rows.write.mode(mode).partitionBy("scenario_id").option("header", True).csv(path)
    else:
        rows.select(*[n for n in rows.columns if n != "scenario_id"], "scenario_id").write.mode(mode).option("header", True).csv(path)


def write_meta_json(records: DataFrame, path: str, partition_by: str | None = None, mode: str = "error") -> None:
    writer = records.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)
