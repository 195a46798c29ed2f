"""The training-data operators against brute force, on small tables with every awkward case."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadweave.llm import (
    embedding_dedup, language_id, license_scan, mixing, ngram_join, packing, pii, quality_rules, toxicity, url_filter,
)
from roadweave.llm.common import crc_bucket
from roadweave.session import cut

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997} x{i % 89}" for i in range(6000))
BASE = " ".join(f"word{i}" for i in range(120))
NEAR = BASE.replace("word60 ", "other ")
TEXTS = [
    (0, BASE, "en", "a"), (1, BASE, "en", "b"), (2, NEAR, "en", None), (3, None, None, "a"), (4, "", "en", "b"),
    (5, " \t\n ", "de", "a"), (6, "one two", "en", "a"), (7, LONG, "fr", "c"), (8, "The the of and a in to mail me at a.b@c.de.", "en", "a"),
    (8, "The the of and a in to mail me at a.b@c.de.", "en", "a"), (9, "é" * 50 + " +49 (30) 1234567 4539 5787 6362 1486 1.2.3.4", "de", "b"),
    (10, "Released under the MIT License.\nline\nline\nline", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, k string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_quality_rules_equal_their_sql(spark, docs, empty):
    import duckdb

    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.register("documents", documents)
    cursor = con.execute(quality_rules.twin_sql())
    names = [c[0] for c in cursor.description]
    got = quality_rules.judge(docs)
    assert rows(got.select(*names)) == sorted(cursor.fetchall())
    assert quality_rules.judge(empty).collect() == []
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == kept
    assert quality_rules.keep(docs).columns == docs.columns


def brute_components(texts):
    sets, parent = {}, {}
    for i, text, *_ in texts:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 90 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_join_equals_brute_force(spark, docs, empty):
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(150)]
    group = []
    for i in range(40):
        words = list(base)
        for p in rng.choice(150, rng.integers(0, 6), replace=False):
            words[p] = f"r{i}_{p}"
        group.append((100 + i, " ".join(words), "en", "a"))
    texts = TEXTS + group
    table = spark.createDataFrame([(*r, "clash", "clash") for r in texts], SCHEMA)
    want = brute_components(texts)
    got = ngram_join.join(table, pivots=3)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got.orderBy("doc_id").collect()] == [(r[0], *want[r[0]]) for r in sorted(texts, key=lambda r: r[0])]
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert ngram_join.join(empty).collect() == []


def test_license_scan_finds_phrases_and_template_blocks(spark, docs, empty):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (got[10].n_base, got[10].first_word, got[10].base_labels) == (1, 3, "mit") and "mit-notice" in got[10].labels
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    assert license_scan.scan(empty).collect() == []
    filler = " ".join(f"f{i}" for i in range(500))
    text = f"{filler} permission is hereby granted free of charge to any person getting a copy of this software and associated files {filler}"
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found.labels == "mit-text" and found.base_labels == "" and found.score >= 0.8
    # Brute force: every block against every template.
    words = license_scan.tokens(text.encode())
    join = license_scan.Join(license_scan.TEMPLATES, Counter(words), 0.8)
    step, last = license_scan.BLOCK // 2, len(words) - license_scan.BLOCK
    best = {}
    for start in sorted({min(s, last) for s in range(0, len(words), step)}):
        have = set(words[start : start + license_scan.BLOCK])
        for k, s in enumerate(join.sets):
            if len(have & s) >= join.need[k]:
                best[k] = max(best.get(k, 0), len(have & s) / len(s))
    assert join.best(words, license_scan.BLOCK) == best and best


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(v) <= 255 for v in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    return [s for _, _, s in sorted(found)]


def test_pii_equals_brute_force_and_redacts(spark, docs, empty):
    odd = "a@b.c..x@d.e a@b.c_x@d.e 1.2.3.4.5.6.7.8 1.2.3.999 " + "9" * 20000 + " +49 (30) 1234567 x@y.z4539578763621486 " + "a" * 20000 + ' token = "24be64439e3e49cf"'
    texts = TEXTS + [(20, odd, "en", "a")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in texts], SCHEMA)
    trees = pii.fit(table)
    got = sorted((r.doc_id, r.base_sha256) for r in pii.detect(table, trees).collect())
    assert got == sorted((r[0], hashlib.sha256(",".join(brute_pii(r[1] or "")).encode()).hexdigest()) for r in texts)
    safe = {r.doc_id: r.text for r in pii.redact(table, trees).collect()}
    assert safe[8].endswith("mail me at [EMAIL].") and safe[3] is None and safe[0] == BASE and "[IP]" in safe[9]
    assert pii.detect(empty, pii.fit(empty)).collect() == []
    plan = pii.detect(table, trees)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_url_filter_rules_and_method(spark):
    urls = [
        "http://x.net/a", "http://example.net/en/1", "https://A.example.com/de/x?y", "http://q.org/fr/z#t", "http://net.com/x", None, "nothing",
        "http://example.net", "http://net/", "http://example.net/en/1",
    ]
    pages = spark.createDataFrame([(i, u, "<p>free bets and cheap pills</p>", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, name string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[i].rule for i in range(10)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, "net/", "example.net/en/"]
    assert [got[i].verdict for i in (0, 1, 2, 3, 8)] == ["block", "allow", "block", "allow", "block"]
    assert (got[2].host, got[2].path, got[5].host, got[5].path) == ("a.example.com", "/de/x", "", "")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge(pages.limit(0)).collect() == []
    assert url_filter.viterbi("freebets", [(0, 4, 10), (4, 4, 10), (0, 1, 1)], 100) == ["free", "bets"]


def test_url_filter_never_broadcasts_exploded_rows(spark):
    hosts = ("a.net", "b.org", "freebets.io")
    pages = spark.createDataFrame([(i, f"http://{hosts[i % 3]}/fr/x{i}", "free bets") for i in range(60)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")  # the pages are below it, the product of two tables of words is not
    try:
        names = cut(spark.createDataFrame([("freebets",)], "name string"))
        tables = [url_filter.judge(pages), url_filter.segment(names, url_filter.word_counts(pages, "html"))]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in tables]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [plan for plan in plans if "BuildLeft" in plan]


def brute_links(vectors):
    good = [(i, np.array(v, float), lab) for i, v, lab in vectors if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in vectors}
    for i, u, a in good:
        for j, v, b in good:
            if i != j and a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links[i] += 1
    return links


def test_embedding_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16))
    vectors = [(i, (centre[i % 30] + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), i % 2) for i in range(200)]
    vectors += [(200, vectors[0][1], 0), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 0), (204, vectors[0][1], None), (205, [1.0, 2.0], 0), (206, [], 0)]
    table = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, label int, node int")
    got = embedding_dedup.dedup(table).cache()
    want = brute_links(vectors)
    assert {r.vec_id: r.n_links for r in got.collect()} == want and sum(want.values()) > 200
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert embedding_dedup.recall(table.where("vec_id < 200"), got) >= 0.9
    assert embedding_dedup.dedup(table.limit(0)).collect() == []


def components(links, n):
    """The least member of each part, by links (a, b)."""
    part = list(range(n))

    def root(i):
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        part[q] = p
    return [root(i) for i in range(n)]


def exact_dedup(spark, x, labels):
    """(got, want): n_links and component_id by vec_id of ``dedup`` and of all pairs of each label."""
    table = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(table).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = []
    for low in range(0, len(u), 500):
        near = (u[low : low + 500] @ u.T >= 0.98) & (labels[low : low + 500, None] == labels[None, :])
        links += [(low + a, b) for a, b in np.argwhere(near).tolist() if low + a != b]
    counts = Counter(a for a, _ in links)
    return got, {i: (counts[i], c) for i, c in enumerate(components(links, len(x)))}


def test_embedding_dedup_finds_isolated_pairs_of_a_large_label(spark):
    rng = np.random.default_rng(8)
    far = rng.normal(size=(10_000, 24)).astype(np.float32)
    twins = (far[:400] + rng.normal(size=(400, 24)) * 0.05).astype(np.float32)
    got, want = exact_dedup(spark, np.vstack([far, twins]), np.zeros(10_400, int))
    assert got == want and sum(n for n, _ in want.values()) >= 800


def test_embedding_dedup_splits_a_large_label_without_loss(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(9000, 3)), rng.normal(size=(30, 3))]).astype(np.float32)
    labels = np.r_[np.zeros(9000, int), np.ones(30, int)]
    fitted = embedding_dedup.fit_cell(pd.DataFrame({"embedding": list(x[:4096]), "size": 9000, "label": 0, "dim": 3, "cell": ""}), embedding_dedup.reach(0.98))
    assert len(fitted) == 1
    got, want = exact_dedup(spark, x, labels)
    assert got == want


def test_embedding_dedup_joins_tight_groups(spark):
    rng = np.random.default_rng(10)

    def group(size, axis, shift):
        x = np.zeros((size, 32))
        x[:, axis], x[:, axis + 1] = 1.0, shift
        return x + rng.normal(size=x.shape) * 0.002

    # A third group, far away, holds the middle of all.
    x = np.vstack([group(120, 0, 0.0), group(120, 0, 0.17), group(400, 8, 0.0)]).astype(np.float32)
    got, want = exact_dedup(spark, x, np.zeros(640, int))
    assert got == want and {c for _, c in got.values()} == {0, 240}


def test_mixing_meets_targets(spark, docs, empty):
    got = mixing.mix_report(docs, block=16).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in TEXTS)
    size = {i: len((t or "").encode().split()) for i, t, *_ in TEXTS}
    assert all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(size[i] for i, *_ in TEXTS), rel=0.02)
    assert rows(mixing.mix_report(docs, block=16)) == sorted(tuple(r) for r in got)
    mixed = Counter()
    for r in mixing.mixed_documents(docs, block=16).collect():
        mixed[r.doc_id] += len(r.text.encode().split())
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    assert mixed == +taken
    assert mixing.mix_report(empty).collect() == []
    assert mixing.targets([100, 100, 10], [1, 2, 3], 210) == pytest.approx([60.0, 120.0, 30.0])
    assert sorted(mixing.permuted(np.arange(1000), 1000, 5).tolist()) == list(range(1000))
    totals = np.array([70, 20, 10])
    assert sum(mixing.shard_counts(totals, s, 10, 10, 1)[1] for s in range(10)).tolist() == totals.tolist()


def test_packing_covers_every_id_once(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    special = [(30, "a<|endoftext|> b.C,d's 3.5...x é'S don't", "en", "a")]
    texts = TEXTS + special
    table = spark.createDataFrame([(*r, "clash", "clash") for r in texts], SCHEMA)
    tokenizer = Tokenizer.from_file(path)
    full = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t, *_ in texts}
    got = packing.pack(table, path).toPandas()
    for r in got.itertuples():
        assert zlib.crc32(full[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(full[r.doc_id])
    copies = Counter(i for i, *_ in texts)
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(v) * copies[i] for i, v in full.items()}
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert packing.pack(empty, path).collect() == []
    assert sum(packing.cut_lengths(12345, 4096, 32)) == 12345


def test_automaton_finds_terms_within_one_edit():
    terms = ["idiot", "pathetic", "stem*"]
    automaton = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for word in ("idiot", "idiots", "pathetic", "pathetc", "patheticc", "apathetic", "pathatic", "stemming", "ste", "pthtic", ""):
        best = min((distance(word, t), k) for k, t in enumerate(terms[:2]) if distance(word, t) <= (1 if len(t) >= toxicity.FUZZY_LENGTH else 0)) if any(
            distance(word, t) <= (1 if len(t) >= toxicity.FUZZY_LENGTH else 0) for t in terms[:2]) else None
        assert automaton.match(word) == ((0, 2) if word.startswith("stem") else best), word


def test_toxicity_separates_held_out_documents(spark, docs, empty):
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    made, labels = [], []
    for i in range(300):
        words = rng.choice(vocabulary, 40).tolist()
        if i % 3 == 0:
            for p in rng.choice(40, 3, replace=False):
                words[p] = str(rng.choice(["pathetic", "worthless", "disgusting"]))
        made.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    table = spark.createDataFrame(made + [(900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    held_out = crc_bucket("doc_id", 5) == 0
    got = toxicity.score(table, toxicity.fit(table.where(~held_out), marks), held_out).collect()
    right = [r.predicted == int(r.doc_id % 3 == 0) for r in got if r.held_out and r.doc_id < 900]
    assert len(got) == 302 and sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.fit(table.limit(0), marks)
    assert {r.score for r in toxicity.score(docs, nothing, crc_bucket("doc_id", 5) == 0).collect()} == {0.0}


def test_toxicity_matches_short_misspellings_symbols_and_quotations():
    model = toxicity.Model({"moron": 3.0, "scum": 3.0, "pathetic": 3.0}, frozenset({"boron"}))

    def found(text):
        return [(i, edits, model.terms[t]) for i, edits, t in model.hits(*toxicity.words_and_joined(text))]

    assert found("a morron, boron") == [(1, 1, "moron")]
    assert found("mor0n path3tic sc*um") == [(0, 1, "moron"), (2, 1, "pathetic"), (4, 1, "scum")]
    assert found("a-moron/scum x1y m0r0n") == [(1, 0, "moron"), (2, 0, "scum")]

    def quoted(text):
        return model.features(text)[6]

    assert quoted('they wrote "what a sad old moron" to me') == 1.0
    assert quoted("„so ein moron“ and «ah scum» and ‘it’s scum’") == 1.0
    assert quoted("> you are all such pathetic people\nno moron here") == 0.5
    assert quoted('"good day" moron') == 0.0 and quoted('the 5" moron') == 0.0


def test_language_id_on_held_out_documents(spark, empty):
    if not os.path.isdir(DATA):
        pytest.skip("benchmark tables are not here")
    table = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(
        spark.createDataFrame([(9001, None), (9002, "12 !!"), (9003, "")], "doc_id long, text string"), allowMissingColumns=True
    )
    held_out = crc_bucket("doc_id", 3) == 1
    model = language_id.fit(table.where(~held_out))
    got = language_id.identify(table, model, held_out).join(table.select("doc_id", "lang"), "doc_id").collect()
    right = [r.lang_pred == r.lang for r in got if r.held_out and r.lang]
    assert sum(right) / len(right) > 0.97
    assert {r.lang_pred for r in got if r.doc_id > 9000} == {"und"}
    assert language_id.identify(empty, model, crc_bucket("doc_id", 3) == 1).collect() == []


def test_pipeline_stages_follow_each_other(spark):
    if not os.path.isdir(DATA):
        pytest.skip("benchmark tables are not here")
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, DATA))
        assert out.columns == columns and out.count() > 0, name
        if name in ("quality_rules", "ngram_join"):
            assert out.count() <= before
        if name == "pii":
            assert out.where("text rlike '[a-z0-9]@mail[0-9]'").count() == 0
        docs, before = out, out.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_queries_are_registered():
    import __spark_entry__ as driver

    names = driver.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_long_lists_do_not_bring_sets_together_that_share_too_little(spark):
    from pyspark.sql import functions as F

    from roadweave.llm import ngram_join as N

    # 30 sets of 100 n-grams; 8 of a prefix are shared: one with a partner each, four with all. At least 5 must be common.
    rows = []
    for node in range(30):
        lists = [(1000 + node // 2 * 10 + i, 2) for i in range(4)] + [(i, 30) for i in range(4)]
        rows += [(token, node, 100, True, 8, c, 8 - at) for at, (token, c) in enumerate(lists)]
    sets = spark.createDataFrame(rows, "token long, node long, n int, early boolean, k int, c int, left int")
    s, t = sets.alias("s"), sets.alias("t")
    met = s.join(t, (F.col("s.token") == F.col("t.token")) & (F.col("s.node") < F.col("t.node")))
    assert met.where(N._early(90)).count() == 4 * 15 + 4 * 30 * 29 // 2
    found = met.where(N._first(90)).select("s.node", "t.node").distinct().toDF("a", "b").collect()
    assert {tuple(r) for r in found} == {(i, i + 1) for i in range(0, 30, 2)}


def test_a_pair_of_sets_is_made_at_few_of_its_shared_tokens(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(600)]
    other = [f"s{i}" for i in range(600)]
    texts = [" ".join(other), " ".join(other[:541]), " ".join(other[30:570])]  # 598, 539 and 538 n-grams: the first two link
    for i in range(30):  # copies a little too far from one another to link
        words = list(base)
        for p in rng.choice(600, 7, replace=False):
            words[p] = f"r{i}_{p}"
        texts.append(" ".join(words))
    rows = [(i, text, "en", "a", 0) for i, text in enumerate(texts)]
    made, pair_up = [], ngram_join._pair_up

    def counted(left, right, condition, prefixes, percent):
        s, t = left.alias("s"), right.alias("t")
        fits = ngram_join._fits(F.col("s.n"), F.col("t.n"), percent)
        met = s.join(t, (F.col("s.token") == F.col("t.token")) & (F.col("s.node") != F.col("t.node")) & fits & condition)
        ends = F.least("s.node", "t.node"), F.greatest("s.node", "t.node")
        made.append(tuple(met.agg(F.count(F.lit(1)), F.count_distinct(*ends)).first()))
        return pair_up(left, right, condition, prefixes, percent)

    monkeypatch.setattr(ngram_join, "_pair_up", counted)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(table, pivots=3).collect()}
    want = brute_components(rows)
    assert got == want and want[1][1] == 0 and want[2][1] == 2
    assert len(made) == 3 and made[2][1] > 100
    assert all(joined <= 2 * pairs for joined, pairs in made), made
