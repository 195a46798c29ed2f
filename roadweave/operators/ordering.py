"""Numbering, running sums, medians and row generation that survive one very large group.

A plain window over a group sorts the whole group in one task. Here the group is cut into slices that follow
the requested order; a small window over slice totals gives each slice its offset and the inner window sees
one slice only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.session import cut

CHUNK = 4096


def running_sum(
    df: DataFrame, keys: list[str], slice_col: Column, order: list[str], value: str, out: str
) -> DataFrame:
    """Exclusive running sum of ``value`` per group.

    ``slice_col`` must not decrease along ``order``; rows of one slice meet in one task, rows of one group do not.
    """
    sliced = df.withColumn("_slice", slice_col)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    inner = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = sliced.join(offsets, [*keys, "_slice"])
    return joined.withColumn(
        out, F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0))
    ).drop("_slice", "_offset")


def running_min(
    df: DataFrame, keys: list[str], slice_col: Column, order: list[str], value: str, out: str
) -> DataFrame:
    """Exclusive running minimum of ``value`` per group, null on the first row of the group."""
    sliced = df.withColumn("_slice", slice_col)
    lows = sliced.groupBy(*keys, "_slice").agg(F.min(value).alias("_low"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = lows.select(*keys, "_slice", F.min("_low").over(before).alias("_before"))
    inner = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(out, F.least(F.col("_before"), F.min(value).over(inner)))
        .drop("_slice", "_before")
    )


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Row number from 0 per group along ``order`` (ascending; make it unique within a group).

    For groups that a parameter or a network bounds (a population, the edges of one area): one task sorts a group.
    """
    return df.withColumn(out, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def number_rows_sliced(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """The same numbers for groups without a bound: no task sorts a whole group.

    Spark ranges the rows over partitions by group and order; the table is stored with its partition numbers, so that the
    counts per partition, which give the offsets, and the numbers within a partition speak of the same rows.
    """
    stored = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = stored.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)) - 1
    numbered = stored.withColumn("_inside", inside)
    # A null key is a group too.
    on = [numbered[k].eqNullSafe(offsets[k]) for k in [*keys, "_part"]]
    joined = numbered.join(offsets, on)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_offset") + F.col("_inside")).cast("bigint").alias(out))


def exact_median(
    df: DataFrame, keys: list[str], value: str, out: str, low: float = 0.0, high: float = 1.0, bins: int = 65536
) -> DataFrame:
    """Exact median per group. ``low``/``high`` only balance the bins; values outside them stay exact.

    Equal values are counted before they travel, and only the one or two bins that hold the middle are sorted.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = known.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    unit = (F.col("_v") - low) / (high - low)
    counts = counts.withColumn(
        "_bin", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)) * bins).cast("int")
    )
    histogram = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bin_n"))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = (
        histogram.withColumn("_cum", F.sum("_bin_n").over(upto))
        .withColumn("_all", F.sum("_bin_n").over(whole))
        .withColumn("_k1", F.floor((F.col("_all") + 1) / 2))
        .withColumn("_k2", F.floor((F.col("_all") + 2) / 2))
        .withColumn("_before", F.col("_cum") - F.col("_bin_n"))
        .where((F.col("_before") < F.col("_k2")) & (F.col("_cum") >= F.col("_k1")))
        .select(*keys, "_bin", "_before", "_k1", "_k2")
    )
    inner = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.join(middle, [*keys, "_bin"]).withColumn("_rank", F.col("_before") + F.sum("_n").over(inner))
    return ranked.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_rank") >= F.col("_k1"), F.col("_v")))
                + F.min(F.when(F.col("_rank") >= F.col("_k2"), F.col("_v")))
            )
            / 2
        ).alias(out)
    )


def explode_range(df: DataFrame, count: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """One row per number 1..count. Large counts are cut into chunks that are spread over tasks first."""
    keep = df.columns
    chunks = df.where(F.col(count) > 0).select(
        *keep, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / chunk))).alias("_chunk")
    )
    first = F.col("_chunk") * chunk + 1
    last = F.least((F.col("_chunk") + 1) * chunk, F.col(count).cast("bigint"))
    return chunks.repartition(F.xxhash64(*_hashable(df), "_chunk")).select(
        *keep, F.explode(F.sequence(first, last)).alias(out)
    )


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every group along ``order``; partially aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
