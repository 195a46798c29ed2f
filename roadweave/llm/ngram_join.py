"""Self-join of documents by the Jaccard similarity of their word n-grams, by vertical partitioning.

All n-grams have one global order: rare ones first, then by hash. Frequencies are counted over all documents in a fixed
number of hash buckets, so what goes to the tasks has a fixed size; any order that depends on the n-gram alone gives right
results, frequencies only make it fast. The order is cut into fragments:

* The first fragment of a document is its prefix: two documents at the threshold share at least one n-gram of it. Equal
  sets are one node; postings of n-grams that several nodes share give the candidate pairs. Their overlap in the prefix
  bounds the whole overlap, which drops documents that merely share a passage.
* The order is also cut into ranges of its own. One after the other, each range is joined and counted by itself: for the
  pairs that remain, the n-grams that both sets hold in the range are counted, the counts are summed per pair, and a pair
  whose sum cannot reach the threshold any more is dropped before the next range. The n-grams of one range at a time are moved.

A long posting list is not paired with itself: its nodes are first paired with about ``PIVOTS`` of its members, the same
ones in every list of a group, and a node does so in its longest lists only. Links found join nodes into components; only pairs of a list that are still in different
components are then compared, each of them. So every link that could change a component is decided exactly, while a
large group of near copies costs rows in proportion to its size. Such a pair, and one of a short list, is made at about one
of the tokens that its sets share, however many these are.

Nodes are distinct sets, not ids, so rows without an id and rows that share one take part like all others.

Defined results: a text without words, empty or null, has no n-gram and links with nothing; a text with fewer words than
``n`` has its whole sequence as its one n-gram; repeated rows are equal sets and share a component; a component is named
by its smallest id, null if none of its rows has one; a row without words is its own component; other columns are never
read; an empty table gives an empty result. N-grams are compared by 64-bit hashes, equal sets by 64-bit hashes of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.llm.common import SPACE_CHARS
from roadweave.llm.components import connected
from roadweave.session import Scratch, pickle_by_value

N = 3
PERCENT = 90
BUCKET_BITS = 20
CHUNKS = 64
FRAGMENT_BITS = 2
PIVOTS = 8
PIVOT_ROUNDS = 2
#: Of its long lists a node meets the pivots in so many, the longest ones: they hold a whole group, much the same nodes in each.
TOP_LISTS = 2
#: So many shared tokens before one are looked at to see that a pair has met already.
LOOK_BACK = 4
#: Pairs of sizes that ask for no more common tokens than these in the prefix meet by the places of their tokens.
FEW = 2
CACHED_WORDS = 200_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


def ngram_set(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The distinct n-gram hashes of a text, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        part = h[i : i + len(out)]
        turn = np.uint64((17 * i) % 64)
        if i:
            part = (part << turn) | (part >> (np.uint64(64) - turn))
        out = (out ^ part) * np.uint64(_MULTIPLIERS[i % 3])
    out ^= out >> np.uint64(32)
    out *= np.uint64(_MULTIPLIERS[0])
    return np.unique(out ^ (out >> np.uint64(29)))


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of ``size`` with one at the threshold."""
    return -(-size * percent // 100)


def least_overlap(size1: int, size2: int, percent: int) -> int:
    """The least overlap with which two sets of these sizes meet the threshold."""
    return -(-(size1 + size2) * percent // (100 + percent))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), _text_key(text_col).alias("key"))


def _text_key(text_col: str) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _set_hash(grams: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(grams.tobytes()), np.int64)[0])


def _measured(texts: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, key, n, node) of documents and, from each task, rows (chunk, counts) of its n-gram counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, waiting, held = WordHashes(), np.zeros(1 << BUCKET_BITS, np.int64), [], 0
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        names = ["doc_id", "key", "n", "node", "chunk", "counts"]

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            ids, keys, sizes, nodes = batch.column(0).to_pylist(), batch.column(2).to_pylist(), [], []
            for text in batch.column(1):
                grams = ngram_set(text.as_py(), n, hashes)
                sizes.append(len(grams))
                nodes.append(_set_hash(grams))
                waiting.append(grams >> np.uint64(64 - BUCKET_BITS))
                held += len(grams)
                if held > 1_000_000:
                    counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(counts))
                    waiting, held = [], 0
            none = [None] * len(ids)
            yield rows(ids, keys, sizes, nodes, none, none)
        if waiting:
            counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(counts))
        if counts.any():
            none = [None] * CHUNKS
            yield rows(none, none, none, none, range(CHUNKS), [c.astype("<u4").tobytes() for c in np.split(counts, CHUNKS)])

    return texts.mapInArrow(run, "doc_id long, key long, n int, node long, chunk int, counts binary")


def _classes(measured: DataFrame) -> np.ndarray:
    """Frequency class of every bucket, 0 for up to twice the mean: one byte a bucket, whatever the size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                total[chunk] = total[chunk] + part if chunk in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], ["chunk", "counts"])

    parts = measured.where("chunk is not null").select("chunk", "counts")
    summed = parts.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary")
    counts = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.int64)
    for chunk, part in summed.collect():
        counts[chunk] += np.frombuffer(part, "<i8")
    flat = counts.ravel()
    mean = max(1.0, flat.mean())
    return np.clip(np.floor(np.log2(np.maximum(flat, 1) / mean)), 0, 60).astype(np.uint8)


def _postings(texts: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(token, node, n, place): the first fragment of every document; places count from 0 in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            tokens, nodes, sizes, counts, places = [], [], [], [], []
            for text in batch.column(1):
                grams = ngram_set(text.as_py(), n, hashes)
                size = len(grams)
                if size:
                    length = size - needed(size, percent) + 1
                    rank = classes[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    tokens.append(grams[np.argsort(rank, kind="stable")[:length]])
                    nodes.append(_set_hash(grams))
                    sizes.append(size)
                    counts.append(length)
                    places.append(np.arange(length, dtype=np.int32))
            if nodes:
                columns = (
                    np.concatenate(tokens).view(np.int64), np.repeat(np.array(nodes, np.int64), counts),
                    np.repeat(np.array(sizes, np.int32), counts), np.concatenate(places),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "place"])

    return texts.mapInArrow(run, "token long, node long, n int, place int")


def _shared(postings: DataFrame) -> DataFrame:
    """(token, node, n, place) of the tokens that at least two different sets hold, one row per token and set.

    Rows arrive sorted by token and set; a run is passed on while it streams by, so a long one is never held.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ["token", "node", "n", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_old = None, False  # the last row, and whether it shares its token with the row before
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([[h], c]) for h, c in zip(held, columns)]
            token, node = columns[0], columns[1]
            first = np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            columns = [c[first] for c in columns]
            token = columns[0]
            same = token[1:] == token[:-1]
            old = np.concatenate([[held_old], same])
            keep = old[:-1] | same
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep], t) for c, t in zip(columns, kinds)], names)
            held, held_old = [c[-1] for c in columns], bool(old[-1])
        if held is not None and held_old:
            yield pa.RecordBatch.from_arrays([pa.array([h], t) for h, t in zip(held, kinds)], names)

    ordered = postings.repartition("token").sortWithinPartitions("token", "node")
    return ordered.mapInArrow(run, "token long, node long, n int, place int")


def _fits(n1: Column, n2: Column, percent: int) -> Column:
    """Length filter: sets whose sizes alone allow the threshold."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _bound(overlap: Column, percent: int) -> Column:
    """Whether a pair with this overlap in the first fragment may meet the threshold.

    Of the document whose prefix ends first in the global order every prefix n-gram outside the overlap is missing from
    the other, so the whole overlap is at most the prefix overlap and what lies behind the longer rest.
    """
    na, nb = F.col("s.n"), F.col("t.n")
    rest = F.ceil(F.greatest(na, nb) * percent / 100) - 1
    return overlap + rest + 1 >= F.ceil((na + nb) * percent / (100 + percent))


def _early(percent: int) -> Column:
    """The token lies in the early part of the smaller document's prefix, and the shared tokens of both allow the threshold."""
    smaller = F.struct("s.n", "s.node") < F.struct("t.n", "t.node")
    return F.when(smaller, F.col("s.early")).otherwise(F.col("t.early")) & _bound(F.least("s.k", "t.k"), percent)


def _first(percent: int) -> Column:
    """The token may be the first that a pair at the threshold shares, in the order of list lengths, short lists first.

    Behind the first one the prefix overlap holds no more tokens than either set has left, so every such pair meets this at
    its first token, and long lists, which come last, bring only sets together that could still share enough in them.
    """
    return _bound(F.least("s.left", "t.left"), percent)


def _meeting(percent: int) -> Column:
    """The token is the one, or among the few, at which a pair of a list is made; every pair at the threshold has one.

    Sizes that ask for more than ``FEW`` common tokens in the prefix: the token may be the first shared one, and none of the
    tokens that either set holds right before it, short lists first, is in what the other holds there. The first shared
    token always meets this; without the look back, sets that share a long prefix would meet at most of its tokens.
    Other sizes, of which so small an overlap says nothing: neither set has more tokens before this one, in the global
    order, than it may lack in the other. The first shared token in that order always meets this.
    """
    fewest = _least_overlap(F.col("s.n"), F.col("t.n"), percent)
    asked = fewest - F.ceil(F.greatest("s.n", "t.n") * percent / 100)
    by_place = (F.col("s.place") <= F.col("s.n") - fewest) & (F.col("t.place") <= F.col("t.n") - fewest)
    return F.when(asked <= FEW, by_place).otherwise(_first(percent) & ~F.arrays_overlap("s.before", "t.before"))


def _pair_up(left: DataFrame, right: DataFrame, condition: Column, prefixes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, na, nb), a < b, of rows that share a token, meet ``condition`` and may still reach the threshold.

    The prefix overlap is counted exactly for the pairs that meet.
    """
    s, t = left.alias("s"), right.alias("t")
    met = s.join(
        t,
        (F.col("s.token") == F.col("t.token"))
        & (F.col("s.node") != F.col("t.node"))
        & _fits(F.col("s.n"), F.col("t.n"), percent)
        & condition,
    )
    lower = F.col("s.node") < F.col("t.node")
    ends = [F.when(lower, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(a) for c, a in (("node", "a"), ("n", "na"))]
    ends += [F.when(lower, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(b) for c, b in (("node", "b"), ("n", "nb"))]
    pairs = met.select(*ends).distinct()
    held = pairs.join(prefixes.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    held = held.join(prefixes.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    sides = held.select("a", "b", common.alias("o"), F.struct(F.col("na").alias("n")).alias("s"), F.struct(F.col("nb").alias("n")).alias("t"))
    return sides.where(_bound(F.col("o"), percent)).select("a", "b", F.col("s.n").alias("na"), F.col("t.n").alias("nb"))


FRAGMENTS = range((1 << FRAGMENT_BITS) + 1)


def _fragments(texts: DataFrame, sets: DataFrame, nodes: DataFrame, n: int, classes: np.ndarray) -> DataFrame:
    """(node, fragment, grams) of the sets in ``nodes``: the global order cut into ranges, frequent n-grams last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found, places, parts = [], [], []
            for text in batch.column(0):
                grams = ngram_set(text.as_py(), n, hashes)
                part = (grams >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int64)
                part[classes[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] > 0] = FRAGMENTS[-1]
                node = _set_hash(grams)
                for f in FRAGMENTS:
                    if len(inside := grams[part == f]):
                        found.append(node)
                        places.append(f)
                        parts.append(inside.view(np.int64))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((found, places, parts), kinds)], ["node", "fragment", "grams"])

    # One row speaks for a set: the one with the smallest id, which the ids and texts find again.
    one = sets.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("_row"))
    wanted = one.select("_row.doc_id", "_row.key").distinct().hint("shuffle_hash").alias("w")
    mine = texts.alias("t").join(wanted, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.key") == F.col("w.key")), "left_semi")
    return mine.select("text").mapInArrow(run, "node long, fragment int, grams array<long>")


def _least_overlap(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil((na + nb) * percent / (100 + percent))


def _linked(scratch: Scratch, pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs at the threshold: each fragment is joined and counted by itself, and the counts are summed per pair.

    A fragment's table holds its n-grams only. A pair whose sum and what is left of its sets cannot reach the least overlap
    does not go on to the next fragment. Rows that repeat a set give equal rows, which fall together.
    """
    c = F.col
    open_pairs = pairs.select("a", "b", "na", "nb", F.lit(0).alias("o"), c("na").alias("ra"), c("nb").alias("rb"))
    nothing = F.array().cast("array<bigint>")
    for f in FRAGMENTS:
        here = fragments.where(c("fragment") == f).select("node", "grams")
        left, right = here.select(c("node").alias("a"), c("grams").alias("ga")), here.select(c("node").alias("b"), c("grams").alias("gb"))
        met = open_pairs.join(left, "a", "left").join(right, "b", "left")
        ga, gb = F.coalesce("ga", nothing), F.coalesce("gb", nothing)
        counted = met.select(
            "a", "b", "na", "nb", (c("o") + F.size(F.array_intersect(ga, gb))).alias("o"),
            (c("ra") - F.size(ga)).alias("ra"), (c("rb") - F.size(gb)).alias("rb"),
        )
        possible = counted.where(c("o") + F.least("ra", "rb") >= _least_overlap(c("na"), c("nb"), percent))
        open_pairs = scratch.put("counted", possible.distinct())
    return open_pairs.where(c("o") * 100 >= (c("na") + c("nb") - c("o")) * percent).select("a", "b")


def _drawn(turn: int, pivots: int) -> Column:
    """About ``pivots`` members of every list of ``c`` rows, others in every turn; lists of the same nodes draw the same ones."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(steps)) * F.col("c") < pivots * steps


def _labelled(
    docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, pivots: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, node) of every row, and (node, component) of the linked sets. Only these tables stay in the folder."""
    texts = _texts(docs, id_col, text_col)
    measured = scratch.put("measured", _measured(texts, n))
    sets = measured.where("chunk is null").select("doc_id", "key", "n", "node")
    classes = _classes(measured)
    shared = scratch.put("shared", _shared(_postings(texts, n, percent, classes)))
    lists = shared.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    # Bounded: a document's prefix.
    prefixes = scratch.put("prefixes", shared.groupBy("node").agg(F.collect_list("token").alias("tokens")))
    # Tokens that a set has left from this one on, short lists first.
    back = W.partitionBy("node").orderBy(F.desc("c"), F.desc("token"))
    left, before = F.row_number().over(back), F.collect_list("token").over(back.rowsBetween(1, LOOK_BACK))
    # The shorter part of the prefix that a document of at least the same size must meet.
    early = F.col("place") <= F.col("n") - _least_overlap(F.col("n"), F.col("n"), percent)
    sized = shared.join(lists, "token").join(prefixes.select("node", F.size("tokens").alias("k")), "node")
    marked = scratch.put("marked", sized.withColumns({"left": left, "before": before, "early": early}).withColumn("top", F.col("left") <= TOP_LISTS))
    scratch.drop("shared")
    long_lists = marked.where(F.col("c") > pivots)
    # Every row of a list meets the list's pivots; two pivots meet once.
    drawn = marked.withColumn("pivot", (F.col("c") <= pivots) | _drawn(0, pivots))
    once = ~F.col("s.pivot") | (F.col("s.node") > F.col("t.node"))
    meeting = (F.col("c") <= pivots) | F.col("top")
    met = F.when(F.col("s.c") <= pivots, _meeting(percent)).otherwise(_early(percent))
    pairs = scratch.put("pairs", _pair_up(drawn.where(meeting), drawn.where("pivot"), once & met, prefixes, percent))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        fragments = scratch.put("fragments", _fragments(texts, sets, nodes, n, classes))
        links = scratch.put(name, _linked(scratch, pairs, fragments, percent))
        scratch.drop("fragments", "counted")
        return links

    links = linked(pairs, "links")
    labels = scratch.put("labels", connected(links, scratch))
    # Long lists again, for pairs in different components only: with the best linked sets as pivots, then every pair.
    for turn in range(1, PIVOT_ROUNDS + 1):
        grouped = scratch.put("grouped", long_lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
        if turn < PIVOT_ROUNDS:
            # A set near the middle of its group links with most drawn pivots, and so does it with those that stand apart.
            links_of = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("_links"))
            best = F.row_number().over(W.partitionBy("token").orderBy(F.desc_nulls_last("_links"), F.xxhash64(F.lit(turn), "node"), "node"))
            few = grouped.join(links_of, "node", "left").withColumn("_best", best).where(F.col("_best") <= 2 * pivots).drop("_links", "_best")
            apart, many = (F.col("s.component") != F.col("t.component")) & _early(percent), grouped.where("top")
        else:
            apart, many, few = (F.col("s.component") < F.col("t.component")) & _meeting(percent), grouped, grouped
        rest = scratch.put("pairs", _pair_up(many, few, apart, prefixes, percent))
        if not rest.isEmpty():
            links = scratch.put("links", links.union(linked(rest, "more")))
            labels = scratch.put("labels", connected(links, scratch))
    scratch.drop("marked", "prefixes", "pairs", "links", "more", "grouped", "stars")
    return sets, labels


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, pivots: int = PIVOTS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    sets, labels = _labelled(docs, id_col, text_col, n, percent, pivots, Scratch(docs.sparkSession, "ngrams"))
    # Sets first, so that the rows of one set are counted before anything is joined.
    known = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("_id")).join(labels, "node", "left")
    grouped = known.select("node", "_id", F.coalesce("component", "node").alias("_group"))
    least = grouped.groupBy("_group").agg(F.min("_id").alias("component_id"))
    named = grouped.join(least, "_group").select("node", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.join(named, "node", "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every component, with all its columns; rows without words link with nothing and all stay.

    It is the row with the smallest id, null ids last; of rows that share that id the one whose text has the smallest
    hash, and of rows with equal id and text any one.
    """
    settings = {"n": N, "percent": PERCENT, "pivots": PIVOTS} | options
    sets, labels = _labelled(docs, id_col, text_col, scratch=Scratch(docs.sparkSession, "ngrams"), **settings)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    known = sets.where("n > 0").groupBy("node").agg(F.min(order).alias("_first")).join(labels, "node", "left")
    first = known.groupBy(F.coalesce("component", "node")).agg(F.min("_first").alias("_first"))
    chosen = first.select(F.col("_first.doc_id").alias("_id"), F.col("_first.key").alias("_key"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_doc"), _text_key(text_col).alias("_text"))
    none = F.length(F.btrim(F.coalesce(F.col(f"_row.{text_col}"), F.lit("")), F.lit(SPACE_CHARS))) == 0
    found = rows.where(~none).join(chosen, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi")
    once = found.groupBy("_doc", "_text").agg(F.first("_row").alias("_row"))
    return once.select("_row.*").unionByName(rows.where(none).select("_row.*"))


pickle_by_value(__name__)
