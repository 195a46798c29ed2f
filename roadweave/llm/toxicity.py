"""Toxicity score of a text: a lexicon matched with one edit, weighed by the words around each match.

The lexicon is learned: words that mark toxic documents by their log odds and stand in several different contexts (words
of a copied text always follow the same word). Its trie is intersected with the Levenshtein automaton of distance one, stems
(``lowe*``) match whatever follows: states are sets of (trie node, edits), built when first met, so a word costs one table step per letter. Each match is
weighed by the words in a window around it and by its place between quotation marks; a logistic model of these sums gives the score.
A digit or symbol between letters (``mor0n``) counts as one edit; words that clean documents use are no misspellings.

Lexicon, context words and weights are fitted on a bounded sample of labelled rows (``per_class`` of each class) and have
fixed bounds; every document is scored over its whole text. Language, source and id are no inputs of a score.

Defined results: a null or empty text has no match and gets the score of such texts; without labels of both classes every
score is 0; repeated rows are scored one by one, a label that occurs twice counts once, an id with both labels for each;
other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import sample_rows
from roadweave.session import pickle_by_value

PER_CLASS = 6000
MAX_TERMS = 2000
MAX_CONTEXT = 2000
MAX_KNOWN = 5000
MIN_CONTEXTS = 3
MIN_LOG_ODDS = 2.0
FUZZY_LENGTH = 4
REACH = 4
CACHED_WORDS = 200_000
MAX_STATES = 200_000
STEM = "*"
STEM_LENGTHS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_CHAIN = re.compile(r"[^\W\d_]++(?:(?!\s)[\W\d_][^\W\d_]++)++")
#: What stands between an opening and its closing mark, and lines behind ``>``. A mark without its other one quotes nothing.
_QUOTED = re.compile(
    r'(?<!\w)"[^"]*+"(?!\w)|“[^“”]*+”|„[^„“”]*+[“”]|«[^«»]*+»|‘(?:[^‘’]|(?<=\w)’(?=\w))*+’|^[ \t]*+>[^\n]*+', re.MULTILINE
)


def words_and_joined(text: str | None) -> tuple[list[str], list[tuple[int, str]]]:
    """The words, and what one digit or symbol joins as (place of its first word, string)."""
    text = (text or "").lower()
    words: list[str] = []
    joined: list[tuple[int, str]] = []
    at = 0
    for m in _CHAIN.finditer(text):
        words += _WORD.findall(text, at, m.start())
        pieces = _WORD.findall(m.group())
        place = 0
        for k, (a, b) in enumerate(zip(pieces, pieces[1:])):
            joined.append((len(words) + k, m.group()[place : place + len(a) + 1 + len(b)]))
            place += len(a) + 1
        words += pieces
        at = m.end()
    return words + _WORD.findall(text, at), joined


class Automaton:
    """The trie of the lexicon intersected with the Levenshtein automaton of distance one, determinised as needed."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        for number, term in enumerate(terms):
            node = 0
            for c in term.rstrip(STEM):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.stems if term.endswith(STEM) else self.ends)[node] = number
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.result: list[tuple[int, int] | None] = []
        self.start = self.state({(0, 0)})

    def state(self, found: set[tuple[int, int]]) -> int:
        """The number of a state, letters of a term that the word leaves out included; -1 if nothing can match, and
        -2 - term once the word has begun with a stem."""
        whole = [self.stems[n] for n, edits in found if edits == 0 and n in self.stems]
        if whole:
            return -2 - min(whole)
        full = found | {(child, 1) for node, edits in found if edits == 0 for child in self.children[node].values()}
        key = frozenset(full)
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
            ends = [(edits, self.ends[n]) for n, edits in key if n in self.ends]
            ends = [x for x in ends if x[0] == 0 or len(self.terms[x[1]]) >= FUZZY_LENGTH]
            self.result.append(min(ends, default=None))
        return self.number[key]

    def step(self, state: int, c: str) -> int:
        found = set()
        for node, edits in self.members[state]:
            children = self.children[node]
            if c in children:
                found.add((children[c], edits))
            if edits == 0:
                found.add((node, 1))
                found.update((child, 1) for child in children.values())
        self.steps[state][c] = out = self.state(found)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within one edit."""
        if len(self.members) > MAX_STATES:
            self.reset()
        state = self.start
        for c in word:
            after = self.steps[state].get(c)
            state = self.step(state, c) if after is None else after
            if state < 0:
                return None if state == -1 else (0, -2 - state)
        return self.result[state]


class Matches(dict):
    """word -> (edits, term) or None, kept up to a bound. Words that clean documents use are no misspellings."""

    def __init__(self, automaton: Automaton, known: frozenset[str]):
        super().__init__()
        self.automaton, self.known = automaton, known

    def __missing__(self, word: str) -> tuple[int, int] | None:
        got = self.automaton.match(word)
        if got and got[0] and word in self.known:
            got = None
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


class Model:
    """Lexicon, context weights and the logistic weights of the document features."""

    def __init__(self, lexicon: dict[str, float], known: frozenset[str] = frozenset(), context: dict[str, float] | None = None, weights: list[float] | None = None):
        self.terms = sorted(lexicon)
        self.strength = [lexicon[t] for t in self.terms]
        self.known, self.context, self.weights = known, context or {}, weights
        self.matches: Matches | None = None

    def __getstate__(self):
        return self.__dict__ | {"matches": None}

    def hits(self, words: list[str], joined: list[tuple[int, str]] = ()) -> list[tuple[int, int, int]]:
        """(place, edits, term) of the words that match, and of two joined words where neither matches."""
        if self.matches is None:
            self.matches = Matches(Automaton(self.terms), self.known)
        found = {i: m for i, m in enumerate(map(self.matches.__getitem__, words)) if m is not None}
        for i, form in joined:
            if i not in found and i + 1 not in found and (m := self.matches[form]) is not None:
                found[i] = m
        return [(i, *m) for i, m in sorted(found.items())]

    def window(self, words: list[str], i: int) -> list[str]:
        return words[max(0, i - REACH) : i] + words[i + 1 : i + 1 + REACH]

    def features(self, text: str | None) -> list[float]:
        words, joined = words_and_joined(text)
        hits = self.hits(words, joined)
        if not hits:
            return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        exact = [h for h in hits if h[1] == 0]
        near = [self.context.get(w, 0.0) for i, _, _ in hits for w in self.window(words, i)]
        quoted = 0.0
        text = text.lower()
        inside = [m.span() for m in _QUOTED.finditer(text)]
        if inside:
            starts, opens = [m.start() for m in _WORD.finditer(text)], [low for low, _ in inside]
            spans = [inside[bisect_right(opens, starts[i]) - 1] for i, _, _ in hits]
            quoted = sum(low <= starts[i] < high for (i, _, _), (low, high) in zip(hits, spans)) / len(hits)
        return [
            1.0,
            float(np.log1p(len(exact))),
            float(np.log1p(len(hits) - len(exact))),
            max([self.strength[t] for _, _, t in exact], default=0.0) / 5,
            sum(near) / len(near) if near else 0.0,
            min(1.0, 20 * len(hits) / len(words)),
            quoted,
        ]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = sum(a * b for a, b in zip(self.weights, self.features(text)))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def _per_word(emit) -> object:
    """A mapInArrow function that sums (positive, negative, context bits) by word in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        bits: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            names = list({*counts[0], *counts[1]})
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()),
                 pa.array([counts[0][w] for w in names], pa.int64()), pa.array([bits.get(w, 0) for w in names], pa.int64())],
                ["word", "pos", "neg", "bits"],
            )
            counts[0].clear(), counts[1].clear(), bits.clear()
            return out

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                emit(text.as_py(), label, counts[label], bits)
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
        yield flush()

    return run


def _seen(text: str | None, label: int, count: Counter, bits: dict[str, int]) -> None:
    words, joined = words_and_joined(text)
    count.update({w for w in words} | {form for _, form in joined} | {w[:n] + STEM for w in set(words) for n in STEM_LENGTHS if len(w) > n})
    if label:
        for before, w in zip(words, words[1:]):
            bit = 1 << (sum(before.encode()) * 31 + len(before)) % 61
            for item in (w, *(w[:n] + STEM for n in STEM_LENGTHS if len(w) > n)):
                bits[item] = bits.get(item, 0) | bit


def _summed(rows: DataFrame, emit) -> DataFrame:
    out = rows.mapInArrow(_per_word(emit), "word string, pos long, neg long, bits long")
    return out.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.expr("bit_or(bits)").alias("bits"))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS
) -> Model:
    """A model of a bounded sample of the labelled documents; ``docs`` holds the rows that may be learned from."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)").distinct()
    ids = sample_rows(marked.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi"), "_id", "_label", per_class)
    # Bounded: per_class ids of each class.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id").select("_label", "text")
    rows = rows.repartition(F.xxhash64("text")).cache()
    size = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    if len(size) < 2:
        rows.unpersist()
        return Model({})
    odds = F.log((F.col("pos") + 0.5) / (size[1] + 1.0)) - F.log((F.col("neg") + 0.5) / (size[0] + 1.0))
    spread = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    per_word = _summed(rows, _seen).select("*", odds.alias("odds"), (odds - 1.5 * spread).alias("sure")).cache()
    terms = per_word.where((F.col("pos") >= 3) & (F.col("sure") >= MIN_LOG_ODDS) & (F.bit_count("bits") >= MIN_CONTEXTS) & (F.length("word") >= 3))
    lexicon = {r["word"]: r["odds"] for r in terms.orderBy(F.desc("odds"), "word").limit(MAX_TERMS).collect()}
    model = Model(lexicon)

    def fuzzy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(model.hits([w])) for w in batch.column(0).to_pylist()], pa.bool_()))

    clean = per_word.where((F.col("neg") >= 1) & (F.col("odds") < 1) & ~F.col("word").endswith(STEM)).select("word", "neg")
    near = clean.mapInArrow(fuzzy, "word string, neg long")
    known = frozenset(r[0] for r in near.orderBy(F.desc("neg"), "word").limit(MAX_KNOWN).collect()) - set(lexicon)
    model = Model(lexicon, known)

    def around(text: str | None, label: int, count: Counter, bits: dict[str, int]) -> None:
        words, joined = words_and_joined(text)
        count.update(w for i, _, _ in model.hits(words, joined) for w in model.window(words, i))

    context = _summed(rows, around).select("*", (F.col("pos") + F.col("neg")).alias("n")).where("n >= 20")
    beside = context.orderBy(F.desc("n"), "word").limit(MAX_CONTEXT).collect()
    all_pos, all_neg = sum(r["pos"] for r in beside), sum(r["neg"] for r in beside)
    weight = {r["word"]: float(np.log((r["pos"] + 5) / (all_pos + 10)) - np.log((r["neg"] + 5) / (all_neg + 10))) for r in beside}
    model = Model(lexicon, known, weight)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = [model.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows_, pa.list_(pa.float64()))], ["label", "x"])

    cells = rows.mapInArrow(measured, "label int, x array<double>").groupBy("label", "x").count().collect()
    cells.sort(key=lambda r: (r["label"], r["x"]))
    rows.unpersist()
    per_word.unpersist()
    x, y, n = np.array([c["x"] for c in cells]), np.array([c["label"] for c in cells], float), np.array([c["count"] for c in cells], float)
    return Model(lexicon, known, weight, _logistic(x, y, n / n.sum()))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Weights of a ridge logistic regression, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move / max(1.0, np.abs(move).max() / 2)
    return w.tolist()


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its score from 0 to 1 and the class at 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


pickle_by_value(__name__)
