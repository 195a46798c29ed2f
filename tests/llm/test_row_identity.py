"""Rows without an id and rows that share one, through the join, the mix and the whole pipeline."""

import os
from collections import Counter

import numpy as np
import pytest

from roadweave.llm import mixing, ngram_join, quality_rules

DATA = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, node long"
BASE = [f"t{i}" for i in range(150)]


def changed(*places):
    words = list(BASE)
    for p in places:
        words[p] = f"r{p}"
    return " ".join(words)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash", 7) for i, t, s in rows], SCHEMA)


ROWS = [
    (1, changed(), "a"), (None, changed(3), "a"), (2, changed(3, 40), None), (2, "nothing like it " * 3, "b"), (2, changed(3, 40), None),
    (None, "alone without an id", "b"), (None, "alone without an id", "b"), (None, None, "b"), (None, None, "b"), (5, "", "a"), (6, " \t", "a"),
    (7, "one", "c"), (8, "ONE", "c"), (9, "one two", "c"),
]


def brute(rows):
    sets = []
    for _, text, _ in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 90 * (len(sets[i]) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    groups = [root(i) for i in range(len(rows))]
    least = {}
    for i, g in enumerate(groups):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    named = [rows[i][0] if not sets[i] else least.get(g) for i, g in enumerate(groups)]
    return [(r[0], len(s), n) for r, s, n in zip(rows, sets, named)], groups, sets


def test_every_row_is_in_the_join(spark):
    want, groups, sets = brute(ROWS)
    docs = table(spark, ROWS)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()]
    assert Counter(got) == Counter(want)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()]
    spoken = Counter()
    for g in {g for g, s in zip(groups, sets) if s}:
        spoken[min((ROWS[i][0] is None, ROWS[i][0] or 0) for i in range(len(ROWS)) if groups[i] == g)] += 1
    assert Counter((i is None, i or 0) for i, t in kept if (t or "").split()) == spoken
    assert Counter(i for i, t in kept if not (t or "").split()) == {None: 2, 5: 1, 6: 1}


def test_groups_longer_than_the_pivots_are_joined_whole(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [(i, changed(*rng.choice(150, rng.integers(0, 6), replace=False).tolist()), "a") for i in range(60)]
    rows += [(200 + i, passage + " " + " ".join(f"own{i}_{k}" for k in range(60)), "a") for i in range(30)]
    want, _, _ = brute(rows)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(table(spark, rows), pivots=2).collect()]
    assert Counter(got) == Counter(want) and len({c for _, _, c in want}) > 31


def test_mixed_documents_agree_with_the_report(spark):
    rows = [(None, "n1 n2 n3 n4", "a"), (None, "m1 m2", "a"), (2, "x1 x2 x3", "b"), (2, "y1 y2 y3 y4 y5 y6 y7", "b"), (2, "x1 x2 x3", "b"), (3, "z1 z2", None), (4, None, "b")]
    docs = table(spark, rows)
    report = Counter()
    for r in mixing.mix_report(docs, block=2).collect():
        report[r.doc_id] += r.taken
    words = Counter()
    for r in mixing.mixed_documents(docs, block=2).collect():
        own = r.text.split()
        words[r.doc_id] += len(own)
        source = next(t.split() for i, t, _ in rows if i == r.doc_id and t and own[0] in t.split())
        at = source.index(own[0])
        assert source[at : at + len(own)] == own and r.token == "clash"
    assert words == Counter({k: v for k, v in report.items() if v}) and words[None] > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="benchmark tables are not here")
@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_takes_awkward_rows(spark, tmp_path, rows):
    import corpus_pipeline

    texts = [r.text for r in quality_rules.keep(spark.read.parquet(f"{DATA}/documents.parquet")).where("length(text) > 500").orderBy("doc_id").limit(4).collect()]
    good = [(100, texts[0], "a"), (101, texts[0], "b"), (None, texts[1], "a"), (100, texts[2], "b"), (None, texts[3], None)]
    table(spark, rows + (good if rows else [])).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    found = pieces.collect()
    # One of the two rows 100 and 101 that agree goes; both rows without an id stay, and so do both texts of id 100.
    assert {r.doc_id for r in found} == ({100, None} if rows else set())
    filled = Counter()
    for r in found:
        filled[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())
