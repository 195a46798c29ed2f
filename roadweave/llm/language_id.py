"""Language of a text by word-first backoff.

A known word scores its log frequency in every language; an unseen word falls back to its character 4-grams, then 3-,
2- and 1-grams, whichever are the longest known. Word and n-gram tables are counted on a bounded sample of labelled rows
(``per_language`` documents of each language) and hold at most ``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams, so that the
model that goes to the tasks has a fixed bound. Every document is scored over its whole text.

Defined results: ``und`` with score 0 for a null text and for one without a letter, or if nothing could be learned; the
score is the posterior of the best language, ties go to the smaller name; repeated rows are scored one by one; other
columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.llm.common import sample_rows
from roadweave.session import pickle_by_value

PER_LANGUAGE = 4000
MAX_WORDS = 120_000
MAX_GRAMS = 120_000
MAX_GRAM = 4
CACHED_WORDS = 200_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter becomes a space.
_SPLIT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPLIT).split()


def grams(word: bytes, n: int) -> list[str]:
    marked = f" {word.decode('utf-8', 'replace')} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram length or 0 for a word, item, n) of the batches, summed per task as far as a bound allows."""
    seen: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = [(lang, 0, w.decode("utf-8", "replace"), n) for lang, c in seen.items() for w, n in c.items()]
        for lang, c in seen.items():
            parts: Counter = Counter()
            for w, n in c.items():
                for k in range(1, MAX_GRAM + 1):
                    for g in grams(w, k):
                        parts[g] += n
            rows += [(lang, len(g), g, n) for g, n in parts.items()]
        seen.clear()
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang", "k", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen[lang].update(w for w in tokens(text.as_py()) if len(w) <= 64)
        if sum(map(len, seen.values())) > 200_000:
            yield flush()
    yield flush()


def _at_most(counts: DataFrame, bound: int) -> DataFrame:
    """The items with the largest totals, at most ``bound`` of them, by a threshold from a histogram of totals."""
    totals = counts.groupBy("k", "item").agg(F.sum("n").alias("total"))
    bins = totals.groupBy(F.floor(F.log2("total") * 8).alias("bin")).count()
    below = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = bins.select("bin", F.sum("count").over(below).alias("upto"))
    floor = ranked.agg(F.max(F.when(F.col("upto") > bound, F.col("bin"))).alias("cut")).collect()[0][0]
    kept = totals if floor is None else totals.where(F.floor(F.log2("total") * 8) > floor)
    return counts.join(kept.select("k", "item"), ["k", "item"], "left_semi")


class Model:
    """Log frequencies by language: words, and n-grams of each length."""

    def __init__(self, rows: list[tuple[str, int, str, int]], langs: list[str], totals: dict[tuple[str, int], int]):
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        index: dict[tuple[bool, str], int] = {}
        counts = defaultdict(lambda: [0] * len(langs))
        for lang, k, item, n in rows:
            counts[(k, item)][place[lang]] += n
        table = np.zeros((len(counts), len(langs)))
        for i, ((k, item), row) in enumerate(sorted(counts.items())):
            # Half a count keeps a language possible that never showed the item.
            norm = np.array([totals.get((lang, k), 0) + 1 for lang in langs], dtype=float)
            table[i] = np.log((np.array(row) + 0.5) / norm)
            index[(k == 0, item)] = i
        self.words = {item.encode("utf-8", "replace"): i for (word, item), i in index.items() if word}
        self.grams = {item: i for (word, item), i in index.items() if not word}
        self.table = table - table.max(axis=1, keepdims=True) if len(table) else table
        self.table = np.clip(self.table, -12, 0).astype(np.float32)
        self.cache: dict[bytes, np.ndarray] = {}

    def unseen(self, word: bytes) -> np.ndarray:
        """Mean over the longest known n-grams of an unseen word; zeros if not even a letter of it is known."""
        got = self.cache.get(word)
        if got is None:
            got = np.zeros(len(self.langs), dtype=np.float32)
            for k in range(MAX_GRAM, 0, -1):
                known = [i for i in map(self.grams.get, grams(word, k)) if i is not None]
                if known:
                    got = self.table[known].mean(axis=0)
                    break
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            if len(word) <= 64:
                self.cache[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        total, unseen, known = np.zeros(len(self.langs)), [], []
        find = self.words.get
        for w in tokens(text):
            i = find(w)
            if i is None:
                unseen.append(w)
            else:
                known.append(i)
        if known:
            total += self.table[known].sum(axis=0, dtype=np.float64)
        for w in unseen:
            total += self.unseen(w)
        best = int(total.argmax())
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of a bounded sample of ``labelled``; rows without a text or language are left out."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = sample_rows(rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")), "_id", "_lang", per_language)
    # Bounded: per_language ids of each language.
    chosen = rows.join(F.broadcast(ids.select("_id", "_lang").distinct()), (F.col(id_col) == F.col("_id")) & (F.col(lang_col) == F.col("_lang")))
    texts = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_count_words, "lang string, k int, item string, n long").groupBy("lang", "k", "item").agg(F.sum("n").alias("n"))
    counts = counts.cache()
    totals = {(r[0], r[1]): r[2] for r in counts.groupBy("lang", "k").agg(F.sum("n")).collect()}
    kept = _at_most(counts.where("k = 0 and n > 1"), MAX_WORDS).unionByName(_at_most(counts.where("k > 0"), MAX_GRAMS))
    model = Model([(r["lang"], r["k"], r["item"], r["n"]) for r in kept.collect()], sorted({lang for lang, _ in totals}), totals)
    counts.unpersist()
    return model


def identify(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its best language and the posterior of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


pickle_by_value(__name__)
