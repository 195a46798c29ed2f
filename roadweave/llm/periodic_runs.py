"""Runs of repeated word sequences by recursive frequency splitting and a lag scan of what is left.

A run is a longest stretch of words with smallest period q and at least max(6, 4q) words. Every word of a run occurs four
times in it, so a word that occurs fewer than four times in a segment lies in no run of that segment and splits it; the
counts of the pieces are taken again until nothing splits. All texts of a group are split together, as one array. The
surviving segments are scanned lag by lag from 1 on: a run of period q holds four words in a row that stand q apart and are
equal, starting at a multiple of q, so only these places are looked at, and a hit inside a run already found is a multiple of
its period. A hit that holds for two periods is extended to both sides.

Texts are worked on one by one in their partition; nothing is shuffled. Defined results: a null or empty text has no words,
no runs and the digest of an empty string twice; a null id damages nothing; repeated rows are scanned one by one; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.session import pickle_by_value

LEAST_WORDS = 6
LEAST_PERIODS = 4
GROUP_WORDS = 200_000


def split_rare(words: np.ndarray, segment: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of ``words`` in which every word occurs often enough for a run.

    ``segment`` numbers the stretches to begin with, in order.
    """
    place = np.arange(len(words))
    while place.size:
        order = np.lexsort((words, segment))
        w, s = words[order], segment[order]
        first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])])
        size = np.diff(np.r_[first, len(order)])
        often = np.zeros(len(order), bool)
        often[order] = np.repeat(size >= LEAST_PERIODS, size)
        before, stays = len(place), often
        place, words, segment = place[stays], words[stays], segment[stays]
        if not place.size:
            return
        new = np.r_[True, (np.diff(place) > 1) | (np.diff(segment) > 0)]
        bounds = np.r_[np.flatnonzero(new), len(place)]
        size = np.diff(bounds)
        stays = np.repeat(size >= LEAST_WORDS, size)
        segment = np.cumsum(new)
        place, words, segment = place[stays], words[stays], segment[stays]
        if len(place) == before:
            break
    if place.size:
        bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(segment) > 0]), len(place)]
        yield from zip(place[bounds[:-1]].tolist(), (place[bounds[1:] - 1] + 1).tolist())


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two equally long arrays agree; looks no further than twice that."""
    done, step = 0, 16
    while done < len(a):
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, 2 * step
    return len(a)


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by a scan of the lags in ascending order."""
    n, found = len(words), []
    covered = np.zeros(n, np.int64)  # the furthest end of a run found so far that holds a place
    for q in range(1, n // LEAST_PERIODS + 1):
        every = words[::q]
        hits = np.flatnonzero((every[:-3] == every[1:-2]) & (every[1:-2] == every[2:-1]) & (every[2:-1] == every[3:])) * q
        hits = hits[covered[hits] <= hits + 3 * q]
        for j in range(1, min(q, 8)):
            if not hits.size:
                break
            hits = hits[(words[hits + j] == words[hits + q + j]) & (words[hits + q + j] == words[hits + 2 * q + j])]
        end = 0
        for x in hits.tolist():
            if x + 3 * q < end:  # in the stretch just looked at
                continue
            ahead = agreement(words[x : n - q], words[x + q :])
            if ahead < 2 * q:
                continue
            behind = agreement(words[:x][::-1], words[q : x + q][::-1])
            start, end = x - behind, x + ahead + q
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q) and covered[start] < end:
                found.append((start, end - start, q))
                np.maximum(covered[start:end], end, out=covered[start:end])
    return sorted((s, k, q) for s, k, q in found)


def runs_by_text(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs of several texts, given as numbers of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    for a, b in split_rare(words, np.repeat(np.arange(len(texts)), sizes)):
        k = int(np.searchsorted(starts, a, "right")) - 1
        out[k] += [(int(a - starts[k]) + s, length, q) for s, length, q in runs_of(words[a:b])]
    return out


def damage(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repeated tail, where the checksum of the id asks for one."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def kept_mask(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words behind the first period of a run."""
    kept = np.ones(n, bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return kept


RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _groups(batches: Iterator[pa.RecordBatch], damaged: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            words = (text.as_py() or b"").split()
            ids.append(doc.as_py())
            texts.append(damage(words, ids[-1]) if damaged else words)
            held += len(words) + 1
            if held >= GROUP_WORDS:
                yield ids, texts
                ids, texts, held = [], [], 0
    yield ids, texts


def _runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    flat = np.empty(sum(map(len, texts)), object)
    flat[:] = [w for words in texts for w in words]
    numbers = pd.factorize(flat)[0]
    return runs_by_text(np.split(numbers, np.cumsum([len(t) for t in texts])[:-1])) if texts else []


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, period, words): every run of every text, with the words of its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches, False):
            rows = [
                (doc, s, k, q, [w.decode("utf-8", "replace") for w in words[s : s + q]])
                for doc, words, runs in zip(ids, texts, _runs(texts)) for s, k, q in runs
            ]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "start", "length", "period", "words"])

    found = _texts(docs, id_col, text_col).mapInArrow(run, "id long, start long, length long, period long, words array<string>")
    return found.withColumnRenamed("id", id_col)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every text with one period left of each run, its words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches, False):
            kept = [b" ".join(_keep(w, r)).decode("utf-8", "replace") for w, r in zip(texts, _runs(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.string())], ["id", "text"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: bool = True) -> DataFrame:
    """Per text: number of runs, the longest run, digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches, damaged):
            rows = []
            for doc, words, runs in zip(ids, texts, _runs(texts)):
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                told = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
                first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                collapsed = b" ".join(_keep(words, runs))
                rows.append((doc, len(runs), *first, hashlib.sha256(told).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return _texts(docs, id_col, text_col).mapInArrow(run, RESULT).withColumnRenamed("doc_id", id_col)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def _keep(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    return [w for w, k in zip(words, kept_mask(len(words), runs).tolist()) if k] if runs else words


pickle_by_value(__name__)
