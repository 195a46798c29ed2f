"""Mixing sources to target weights by fixed-length blocks.

The words of a source, its documents one behind the other in hash order, are cut into blocks of ``block`` words. The mix
is a row of slots, ``shard`` of them to an output shard. How many slots of a shard each source gets is a multinomial
draw conditioned on the source's total (a multivariate hypergeometric draw, split down a binary tree of shards), so every
source meets its target to within a block and every shard can be drawn alone. The t-th slot of a source takes the block at
place t of a pseudorandom index permutation of the source, a new permutation each time all blocks have been taken; slots
and blocks meet in a join by block number. No block is taken more than ``max_repeats`` times.

Defined results: a null or empty text has size 0 and is never taken; null is a source of its own, the last; repeated rows
are mixed one by one; other columns are never read (``mixed_documents`` passes them on); an empty table gives an empty
result. Only one row per source reaches the driver, and at most ``MAX_SOURCES`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.llm.common import text_or_empty, words_of
from roadweave.session import cut, pickle_by_value

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK = 128
SHARD = 4096
SLICES = 1024
SEED = 20240
MAX_SOURCES = 100_000


def source_key(column: str = "source") -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(column)), F.lit("1"))


def targets(sizes: list[int], weights: list[float], total: float, max_repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight; what exceeds ``max_repeats`` times a size goes to the others by weight."""
    target, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(total)
    while open_:
        scale = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * scale > max_repeats * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i] * scale
            break
        for i in over:
            target[i] = float(max_repeats * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 applied to ``index``: a four-round Feistel network, walked until it
    lands inside the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(hash((key, r)) & 0xFFFFFFFFFFFFFFFF) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def shard_counts(totals: np.ndarray, shard: int, shards: int, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it): the walk down the tree of shards."""
    before, here, low, high = np.zeros_like(totals), totals.copy(), 0, shards
    slots = int(totals.sum())
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        n_left = min(middle * per_shard, slots) - low * per_shard
        left = _split(rng, here, n_left)
        if shard < middle:
            here, high = left, middle
        else:
            before, here, low = before + left, here - left, middle
    return before, here


def _split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the slots drawn without replacement, by source; large numbers by the normal limit of the same draw."""
    out, left, n_left = np.zeros_like(counts), int(counts.sum()), int(n)
    for i, c in enumerate(counts.tolist()):
        rest = left - c
        if n_left <= 0:
            break
        if left < 1_000_000_000:
            k = int(rng.hypergeometric(c, rest, n_left)) if c else 0
        else:
            p = c / left
            sd = np.sqrt(n_left * p * (1 - p) * (left - n_left) / max(left - 1, 1))
            k = int(round(rng.normal(n_left * p, sd)))
            k = max(0, n_left - rest, min(k, c, n_left))
        out[i], left, n_left = k, rest, n_left - k
    return out


class Mix:
    """The plan of one mix: sizes, targets and slots of every source, all bounded by the number of sources."""

    def __init__(self, rows: list[tuple[str, int]], weights: tuple[float, ...], max_repeats: int, block: int, shard: int, seed: int):
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        rows = sorted(rows)
        self.names, self.sizes = [k for k, _ in rows], [int(n or 0) for _, n in rows]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(rows))], sum(self.sizes), max_repeats)
        self.blocks = [-(-n // block) for n in self.sizes]
        self.slots = [
            min(max_repeats * b, round(t * b / n)) if n else 0 for t, b, n in zip(self.targets, self.blocks, self.sizes)
        ]
        self.block, self.shard, self.seed = block, shard, seed

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.names, self.sizes, map(float, self.targets)))
        return spark.createDataFrame(rows, "skey string, source_size long, target double")

    def draws(self, spark: SparkSession) -> DataFrame:
        """(shard, slot, skey, block): the whole mix, one row per slot."""
        names, blocks, totals, per, seed = self.names, self.blocks, np.array(self.slots, dtype=np.int64), self.shard, self.seed
        shards = -(-int(totals.sum()) // per) if len(totals) else 0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids in batches:
                for number in ids["id"].tolist():
                    before, here = shard_counts(totals, number, shards, per, seed)
                    parts = []
                    for i, n in enumerate(here.tolist()):
                        t = np.arange(before[i], before[i] + n)
                        for epoch in np.unique(t // blocks[i]) if n else ():
                            inside = t[t // blocks[i] == epoch] % blocks[i]
                            parts.append(pd.DataFrame({"skey": names[i], "block": permuted(inside, blocks[i], (seed * 1_000_003 + i) * 8 + int(epoch))}))
                    if parts:
                        rows = pd.concat(parts, ignore_index=True)
                        order = np.random.default_rng([seed, number, 1]).permutation(len(rows))
                        yield pd.DataFrame({"shard": number, "slot": order, "skey": rows["skey"], "block": rows["block"]})

        tasks = max(1, min(shards, 20_000))
        return spark.range(0, shards, 1, tasks).mapInPandas(run, "shard long, slot long, skey string, block long")


def row_key(docs: DataFrame) -> Column:
    """Hash of all columns of a row but maps."""
    return F.xxhash64(*[f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")])


def lay_out(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, key, skey, size, off): the place of every document in the words of its source.

    Documents follow the hash of their id, rows without one that of their columns; sizes are summed per hash slice first,
    so that no task orders a whole source. ``key`` tells rows with one id apart: equal ones agree in all columns.
    """
    key = row_key(docs)
    slice_ = F.pmod(F.xxhash64(F.lit(SEED), F.coalesce(F.col(id_col).cast("long"), key)), F.lit(SLICES)).cast("int")
    size = F.size(words_of(text_or_empty(text_col))).cast("bigint")
    columns = (F.col(id_col).alias("doc_id"), key.alias("key"), source_key(source_col).alias("skey"), size.alias("size"), slice_.alias("slice"))
    sized = cut(docs.select(*columns))
    slices = sized.groupBy("skey", "slice").agg(F.sum("size").alias("n"))
    before = W.partitionBy("skey").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = slices.select("skey", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slice_off"))
    inner = W.partitionBy("skey", "slice").orderBy("doc_id", "size", "key").rowsBetween(W.unboundedPreceding, -1)
    return sized.join(starts, ["skey", "slice"]).select(
        "doc_id", "key", "skey", "size", (F.col("slice_off") + F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("off")
    )


def usage(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED,
) -> tuple[DataFrame, Mix]:
    """(doc_id, key, skey, size, off, at, n, uses): every stretch of a document that lies in one block, and how often the mix
    takes that block. A document without words has one row of length 0."""
    spark = docs.sparkSession
    laid = cut(lay_out(docs, id_col, text_col, source_col))
    mix = Mix([(r[0], r[1]) for r in laid.groupBy("skey").agg(F.sum("size")).collect()], weights, max_repeats, block, shard, seed)
    first_block, last_block = F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block)
    # Documents without words get block numbers of their own, below zero and spread, so that they do not meet in one task.
    none = F.array(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    pieces = laid.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first_block, last_block)).otherwise(none)))
    start = F.greatest("off", F.col("block") * block)
    end = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block)
    filled = F.col("size") > 0
    pieces = pieces.withColumn("at", F.when(filled, start - F.col("off")).otherwise(0))
    pieces = pieces.withColumn("n", F.when(filled, end - start).otherwise(0))
    uses = mix.draws(spark).groupBy("skey", "block").agg(F.count(F.lit(1)).alias("uses"))
    # The draws start from a short range, so their size would be guessed far too small: never broadcast them.
    joined = pieces.join(uses.hint("merge"), ["skey", "block"], "left")
    return joined.select("doc_id", "key", "skey", "size", "off", "at", "n", F.coalesce("uses", F.lit(0)).alias("uses")), mix


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words of it that the mix takes."""
    stretches, mix = usage(docs, **options)
    taken = stretches.groupBy("doc_id", "skey", "size", "off").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"), F.count(F.lit(1)).alias("_rows"))
    # Documents without words share their place, so equal rows may have met in one group: give each its row back.
    copies = F.when(F.col("size") == 0, F.col("_rows")).otherwise(F.lit(1))
    rows = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    known = mix.catalogue(docs.sparkSession)
    return rows.join(F.broadcast(known), "skey").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: for every repetition of a document the runs of its words that the mix takes.

    A document taken whole keeps its text; a run of it joins its words with single spaces. Other columns are repeated. Rows
    find their runs by id, null or not, and the hash of their columns; equal rows share theirs.
    """
    stretches, _ = usage(docs, id_col=id_col, text_col=text_col, **options)
    taken = stretches.where(F.col("n") * F.col("uses") > 0).select(
        "doc_id", "key", "off", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("uses"))).alias("turn"), "at", (F.col("at") + F.col("n")).alias("to")
    )
    order = W.partitionBy("doc_id", "key", "off", "turn").orderBy("at")
    fresh = F.when(F.lag("to").over(order) == F.col("at"), 0).otherwise(1)
    runs = (
        taken.withColumn("_fresh", fresh)
        .withColumn("_run", F.sum("_fresh").over(order))
        .groupBy("doc_id", "key", "off", "turn", "_run")
        .agg(F.min("at").alias("_at"), F.max("to").alias("_to"))
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("off", "turn", "_at", "_to")).alias("_runs"))
    )
    # Equal rows become one, so that the texts are dealt once, by the key that the runs join on.
    size = F.size(words_of(text_or_empty(text_col))).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(docs).alias("key"), F.struct(*docs.columns).alias("_row"), size.alias("_size"))
    mine = rows.where(F.col("_size") > 0).groupBy("doc_id", "key").agg(F.first("_row").alias("_row"), F.first("_size").alias("_size"))
    same = mine["doc_id"].eqNullSafe(runs["doc_id"]) & (mine["key"] == runs["key"])
    joined = mine.join(runs.hint("merge"), same).select("_row", "_size", "_runs")
    out = joined.select("_row", "_size", F.explode(F.array_sort("_runs")).alias("_r"))
    whole = (F.col("_r._at") == 0) & (F.col("_r._to") == F.col("_size"))
    words = words_of(F.col("_row")[text_col])
    part = F.array_join(F.slice(words, (F.col("_r._at") + 1).cast("int"), (F.col("_r._to") - F.col("_r._at")).cast("int")), " ")
    out = out.withColumn("_text", F.when(whole, F.col("_row")[text_col]).otherwise(part))
    made = {text_col: F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return out.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


pickle_by_value(__name__)
