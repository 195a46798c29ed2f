"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.filter(F.split(trimmed, SPACE + "+"), lambda w: w != "")


def crc_bucket(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts


def sample_rows(labelled: DataFrame, id_col: str, stratum: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of every value of ``stratum``, those with the smallest hash of the id.

    ``stratum`` must have few values (classes, languages): their counts are read by the driver. The hash limit cuts
    the rows to about twice the bound before they are ranked, so no task ranks all rows of a large stratum.
    """
    counts = labelled.groupBy(stratum).count().collect()
    steps = 1 << 30
    place = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(steps))
    near = F.lit(False)
    for value, n in counts:
        if value is not None:
            limit = steps if n <= 2 * bound else int(steps * 2 * bound / n)
            near = near | ((F.col(stratum) == F.lit(value)) & (place < limit))
    order = W.partitionBy(stratum).orderBy(place, id_col)
    ranked = labelled.where(near).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= bound).drop("_rank")
