"""Conversation repair, periodic runs and byte-level BPE against brute force and the tokenizer itself."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from roadweave.llm import bpe, conversation_repair, periodic_runs

SPACE = " \t\n\x0b\x0c\r"
WIDE = ", start string, ids string, gone string, fault string"


# Conversations


def damaged(rows):
    """The rows of every conversation after damage, by a plain loop."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute_repair(rows):
    """Cheapest (cost, audit, repaired rows) by trying edits in order of cost and audit; any number of insertions."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return faults, cost, audit, out
        if (i, initials[-1:]) in done or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        done.add((i, initials[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, initials + role[0], (*out, role + ":")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, initials, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if own:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials + own[0], (*out, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, initials + role[0], (*out, f"{role}:{text}")))
    raise AssertionError


def expected_conversations(rows):
    want = {}
    for conv, mine in damaged(rows).items():
        faults, cost, audit, out = brute_repair(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        starts = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        n = Counter(faults)
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        want[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest, list(out))
    return want


def make_conversations():
    rnd, rows = random.Random(5), []
    texts = ["Yes.", "No!", "why", "a. ", " ", "", None, "é?\n", "Yes."]
    for conv in [None, *range(400)]:
        for turn in range(rnd.randrange(1, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 2]), role, rnd.choice([*texts, f"t{turn}.", f"t{turn}."])))
    rows += rows[:40]
    for turn in range(700):  # several blocks
        rows.append((-7, turn, rnd.choice(["user", "assistant", "assistant", "tool"]), rnd.choice([f"t{turn}.", f"t{turn}"])))
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def conversations():
    return make_conversations()


def test_repair_equals_search(spark, conversations):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in conversations], CONV + WIDE).repartition(3)
    rows = conversation_repair.damage(df)
    found = conversation_repair.repair(rows)
    want = expected_conversations(conversations)
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    assert len({w[6] for w in want.values()}) > 50
    out = {}
    for r in sorted(conversation_repair.repaired_rows(rows, found).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert out == {c: w[-1] for c, w in want.items() if w[-1]}


def test_repair_twin_equals_search(conversations):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in conversations])
    got = {r[0]: tuple(r[1:]) for r in con.execute(conversation_repair.twin_sql()).fetchall()}
    assert got == {c: w[:-1] for c, w in expected_conversations(conversations).items()}


def test_repair_of_nothing_and_of_dropped_rows(spark):
    empty = spark.createDataFrame([], CONV)
    assert conversation_repair.repair(conversation_repair.damage(empty)).collect() == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "hello")], CONV)
    row = conversation_repair.repair(conversation_repair.damage(df)).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_blocks_do_not_change_a_repair():
    rnd = random.Random(8)
    for _ in range(200):
        rows = [(k, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice([0, 0, 3])) for k in range(rnd.randrange(30))]
        results = set()
        for block in (1, 3, 64):
            kind = type("Small", (conversation_repair.Repair,), {})
            fold = kind()
            original, conversation_repair.BLOCK = conversation_repair.BLOCK, block
            try:
                for turn, role, fault in rows:
                    fold.add(turn, role, f"t{turn}", fault)
                results.add(fold.result())
            finally:
                conversation_repair.BLOCK = original
        assert len(results) == 1


# Periodic runs


def brute_runs(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[i + t] == w[i + t + d] for t in range(n - d)) for d in range(1, q)):
                found.add((i, n, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(found)


def random_words(rnd):
    k, n, w = rnd.choice([1, 2, 2, 3, 5]), rnd.randrange(70), []
    while len(w) < n:
        part = [rnd.randrange(k) for _ in range(rnd.randrange(1, 7))]
        w += part * rnd.randrange(1, 7) + part[: rnd.randrange(len(part) + 1)] if rnd.random() < 0.5 else [rnd.randrange(k + 3) for _ in range(rnd.randrange(5))]
    return w


def test_runs_equal_brute_force():
    rnd, total = random.Random(3), 0
    for _ in range(60):
        texts = [random_words(rnd) for _ in range(20)]
        want = [brute_runs(w) for w in texts]
        assert periodic_runs.runs_by_text([np.array(w, np.int64) for w in texts]) == want
        total += sum(map(len, want))
    assert total > 1000


@pytest.mark.parametrize("words", [np.zeros(200_000, np.int64), np.tile(np.arange(50_000), 4), np.random.default_rng(0).integers(0, 2, 50_000)])
def test_long_texts_are_scanned_in_time(words):
    got = periodic_runs.runs_by_text([words])[0]
    if len(set(words.tolist())) != 2:
        period = len(set(words.tolist()))
        assert got == [(0, len(words), period)]
    else:
        assert len(got) > 500


def run_rows():
    rnd = random.Random(11)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x  a\tb\na b a b a b\x0bc", "é " * 9, " ".join(f"w{i}" for i in range(9000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 7), (5, "a a a a a a")]
    return rows + [(100 + i, " ".join(f"w{x}" for x in random_words(rnd))) for i in range(300)]


def expected_report(doc, text):
    w = re.findall("[^ \t\n\x0b\x0c\r]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w) if n < 5000 else []
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *first, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def by_text(rows):
    return sorted(rows, key=repr)


def test_run_report_equals_brute_force(spark):
    rows = run_rows()
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "doc_id long, text string" + WIDE)
    assert by_text(tuple(r) for r in periodic_runs.report(df).collect()) == by_text(expected_report(*r) for r in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10
    assert periodic_runs.report(df.limit(0)).collect() == []
    text = {r.doc_id: r.text for r in periodic_runs.collapse(df).collect()}
    assert text[6] == "x a b c" and text[3] == "a" and text[0] == ""
    runs = [tuple(r) for r in periodic_runs.find_runs(df.where("doc_id in (5, 6)")).collect()]
    assert sorted(runs) == [(5, 0, 6, 1, ["a"]), (5, 0, 6, 1, ["a"]), (6, 1, 8, 2, ["a", "b"])]


# BPE

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


def bpe_texts():
    rnd = random.Random(1)
    alphabets = ["ab", "aab ", "abcdefghij  \n", "the and ing on tion  ", " \n\t\x0b x\x1c", "éàüß ab", "日本語かな a1", "'s't're 12 .,!?-=_", "՘\U00010940ab 1", "ÃÂÃÂa", "<|endoftext|>"]
    texts = ["", None, "a" * 3000, "ÃÂ" * 300, " " * 2000 + "x", "x" + "\n" * 900, "-" * 1000, "a<|endoftext|>b <|endoftext|><|endoftext|>"]
    for _ in range(1500):
        alphabet = rnd.choice(alphabets)
        texts.append("".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 5, 30, 200]))) + rnd.choice(["", " <|endoftext|> x"]))
    return texts


def test_round_trip_equals_the_tokenizer(spark, library):
    texts = bpe_texts()
    rows = [*enumerate(texts), (None, "null id"), (3, "repeated id"), (3, "repeated id")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "doc_id long, text string" + WIDE)

    def want(doc, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return doc, len(ids), sha(",".join(map(str, ids))), sha(back)

    got = bpe.round_trip(df, PATH)
    found = got.collect()
    assert by_text(tuple(r)[:4] for r in found) == by_text(want(*r) for r in rows)
    assert 0 < sum(r.words_merged for r in found) < sum(r.words_new for r in found)
    assert bpe.round_trip(df.limit(0), PATH).collect() == []
    encoded = bpe.encode(df.where("doc_id < 300"), PATH)
    ids = {r.doc_id: r.ids for r in encoded.where("doc_id <> 3").collect()}
    assert all(ids[i] == library.encode(texts[i] or "", add_special_tokens=False).ids for i in ids)
    back = {r.doc_id: r.text for r in bpe.decode(encoded.where("doc_id <> 3"), PATH).collect()}
    assert back == {i: texts[i] or "" for i in ids}


def test_merging_alone_and_side_by_side_agree_with_the_tokenizer(vocabulary, library):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randrange(1, 60))) for _ in range(500)]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [vocabulary.merge(w.encode()) for w in words] == want
    assert [x.tolist() for x in vocabulary.merge_rows([w.encode() for w in words])] == want
    packed, merged = vocabulary.encode_words(words)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == want and 0 < merged < len(words)


def test_compatible_pairs_are_the_ones_that_stay_apart(vocabulary, library):
    rng = np.random.default_rng(4)
    plain = np.array([i for i, p in enumerate(vocabulary.pieces) if p.isalpha() and p.isascii() and len(p) < 6])
    a, b = rng.choice(plain, 4000), rng.choice(plain, 4000)
    stays = [vocabulary.merge(vocabulary.pieces[x] + vocabulary.pieces[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert vocabulary.compatible(a, b).tolist() == stays and 500 < sum(stays) < 3500


def test_small_memory_gives_the_same_ids(vocabulary, library):
    texts = [t for t in bpe_texts() if t][:300]
    encoder, got = bpe.Encoder(vocabulary, cached=50, chunk=7), {}
    original, bpe.LONG_TEXT = bpe.LONG_TEXT, 40
    try:
        for key, ids, _ in encoder.encode((i, t.encode()) for i, t in enumerate(texts)):
            got.setdefault(key, []).extend(ids.tolist())
    finally:
        bpe.LONG_TEXT = original
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_pattern_agrees_with_the_tokenizer_below_its_bound():
    narrow, library = bpe.Splitter({}).narrow, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for c in map(chr, range(bpe.AGREED)):
        probe = f"a{c}{c}b1{c}2 {c}.{c}. {c}  {c} x"
        assert narrow.findall(probe) == [probe[i:j] for _, (i, j) in library.pre_tokenize_str(probe)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))


def test_broken_bytes_decode_as_in_the_tokenizer(vocabulary, library):
    rng = np.random.default_rng(6)
    for _ in range(200):
        ids = rng.integers(0, 50257, 12).astype(np.int32)
        assert bpe.decode_ids(vocabulary, ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)
