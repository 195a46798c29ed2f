"""Byte-level BPE encoding and decoding with a public vocabulary: speculate with longest matches, verify pairs, repair.

For the distinct words of a group of texts, the longest vocabulary entry at every byte is found for all bytes at once and
followed from the start of each word: a greedy proposal. It is the encoding exactly if every two neighbours are
compatible, that is if no merge across their border would have come before the merges that built them. All pairs are
tested together, by taking both tokens apart along the border in the reverse order of their merges. Only words with a
failing pair are merged step by step. Each text is worked on alone in its partition and nothing is shuffled; the tables of the
vocabulary file go to the tasks as one broadcast, whose size the file bounds.

Defined results: a null or empty text has no ids and decodes to an empty text; bytes that are no UTF-8 count as U+FFFD; a
text that spells an added token yields its id, as in the tokenizer; repeated rows are encoded one by one; other columns
are not read; an empty table gives an empty result. Words are taken in chunks, so a very long text needs no more memory
than its own text and, where they are returned, its ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from roadweave.session import pickle_by_value

#: Fixed value: the words of the vocabulary's tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below this are letters, digits and spaces alike for the pattern and for the tokenizer (tested).
AGREED = 0x530
_BEYOND = re.compile(f"[^\\x00-{chr(AGREED - 1)}]")
CHUNK_WORDS = 100_000
CACHED_WORDS = 400_000
LONG_TEXT = 1 << 20
#: Words of up to so many bytes are merged side by side as rows of one array, longer ones alone.
SIDE_BY_SIDE = 48
_NEVER = np.iinfo(np.int32).max


def narrow_pattern() -> str:
    """``WORD_PATTERN`` for characters below ``AGREED``, its classes written out so that the faster engine takes it."""

    def members(kind: str) -> str:
        codes = [c for c in range(AGREED) if regex.match(kind, chr(c))]
        firsts = [c for c in codes if c - 1 not in set(codes)]
        lasts = [c for c in codes if c + 1 not in set(codes)]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(firsts, lasts))

    letters, digits, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    spelled = WORD_PATTERN.replace("[^\\s\\p{L}\\p{N}]", f"[^{spaces}{letters}{digits}]").replace("\\S", f"[^{spaces}]")
    return spelled.replace("\\s", f"[{spaces}]").replace("\\p{L}", f"[{letters}]").replace("\\p{N}", f"[{digits}]")


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in prints}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(prints))}
    return letters


@dataclass
class Vocabulary:
    """Tables of a vocabulary: bytes of each id, merges, and a trie of the ids that encode to themselves."""

    pieces: list[bytes]
    added: dict[str, int]
    byte_id: np.ndarray
    rank: np.ndarray  # of the merge that makes an id, -1 for a byte
    left: np.ndarray
    right: np.ndarray
    pair_key: np.ndarray
    pair_rank: np.ndarray
    pair_id: np.ndarray
    merges: dict[tuple[int, int], tuple[int, int]]
    trie_key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    trie_child: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    trie_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a tokenizer file; ``ValueError`` if it is no plain byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE {odd}")
        letters, vocab = byte_letters(), model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
        for content, i in added.items():
            pieces[i] = content.encode()
        byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        rank, left, right = (np.full(len(pieces), -1, np.int32) for _ in range(3))
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            merges.setdefault((x, y), (k, z))
            if rank[z] < 0:
                rank[z], left[z], right[z] = k, x, y
        order = sorted(merges)
        found = cls(
            pieces, added, byte_id, rank, left, right, np.array([a << 32 | b for a, b in order], np.int64),
            np.array([merges[p][0] for p in order], np.int32), np.array([merges[p][1] for p in order], np.int32), merges,
        )
        found._grow_trie([i for i in vocab.values() if found.merge(pieces[i]) == [i]])
        return found

    def _grow_trie(self, ids: list[int]) -> None:
        children: dict[int, int] = {}
        ends = {}
        for i in ids:
            node = 0
            for b in self.pieces[i]:
                node = children.setdefault(node << 8 | b, len(children) + 1)
            ends[node] = i
        keys = sorted(children)
        self.trie_key = np.array(keys, np.int64)
        self.trie_child = np.array([children[k] for k in keys], np.int32)
        self.trie_id = np.full(len(children) + 1, -1, np.int32)
        self.trie_id[list(ends)] = list(ends.values())

    def merge(self, data: bytes) -> list[int]:
        """Ids of a word by merging the pair of least rank, the leftmost of equals, until none is left."""
        ids = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        waiting = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, i, made, a, b = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(waiting, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair, ``_NEVER`` if there is none, and its place in the tables."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[k] == key, self.pair_rank[k], _NEVER), k

    def merge_rows(self, words: list[bytes]) -> list[np.ndarray]:
        """``merge`` of many short words: in each round every row merges its pair of least rank, the leftmost of equals."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        ids = np.full((len(words), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ranks, column = self.find(ids[:, :-1], ids[:, 1:])[0], np.arange(width + 1)
        row, out = np.arange(len(words)), [np.zeros(0, np.int32)] * len(words)
        while True:
            at = ranks.argmin(axis=1)
            on = ranks[np.arange(len(row)), at] < _NEVER
            for k, found in zip(row[~on].tolist(), ids[~on]):
                out[k] = found[found >= 0]
            row, ids, ranks, at = row[on], ids[on], ranks[on], at[on]
            if not row.size:
                return out
            here = np.arange(len(row))
            made = self.pair_id[self.find(ids[here, at], ids[here, at + 1])[1]]
            ids = np.take_along_axis(ids, np.minimum(column + (column > at[:, None]), width), 1)
            ids[:, width] = -1
            ids[here, at] = made
            ranks = np.take_along_axis(ranks, np.minimum(column[:width] + (column[:width] > at[:, None]), width - 1), 1)
            ranks[:, width - 1] = _NEVER
            ranks[here, at] = self.find(made, ids[here, at + 1])[0]
            left = np.maximum(at - 1, 0)
            ranks[here, left] = np.where(at > 0, self.find(ids[here, left], made)[0], ranks[here, left])

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches of all words [start, end) of ``data``: (word, id) of each token, and its place."""
        stop = np.repeat(ends, ends - starts)
        ids, length = self.byte_id[data], np.ones(len(data), np.int64)
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while at.size:
            inside = at + depth < stop[at]
            at, node = at[inside], node[inside]
            key = node << 8 | data[at + depth]
            k = np.minimum(np.searchsorted(self.trie_key, key), len(self.trie_key) - 1)
            hit = self.trie_key[k] == key
            at, node = at[hit], self.trie_child[k[hit]].astype(np.int64)
            depth += 1
            token = self.trie_id[node]
            whole = token >= 0
            ids[at[whole]], length[at[whole]] = token[whole], depth
        is_start, now, end = np.zeros(len(data), bool), starts, ends
        while now.size:
            is_start[now] = True
            now = now + length[now]
            more = now < end
            now, end = now[more], end[more]
        place = np.flatnonzero(is_start)
        word = np.repeat(np.arange(len(starts)), ends - starts)[place]
        return word, ids[place], place

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between each a and b: no merge across it comes before those that built them."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        l, r = a.astype(np.int64), b.astype(np.int64)
        until_l, until_r = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while live.size:
            across = self.find(l, r)[0]
            # Of equal merges the leftmost comes first: one on the left of the border wins, one on its right loses.
            crossed = (across < until_l) & (across <= until_r)
            ok[live[crossed]] = False
            on = ~crossed & ((self.rank[l] >= 0) | (self.rank[r] >= 0))
            live, l, r, until_l, until_r = live[on], l[on], r[on], until_l[on], until_r[on]
            open_left = self.rank[l] > self.rank[r]
            until_l, until_r = np.where(open_left, self.rank[l], until_l), np.where(open_left, until_r, self.rank[r])
            l, r = np.where(open_left, self.right[l], l), np.where(open_left, r, self.left[r])
        return ok

    def encode_words(self, words: list[str]) -> tuple[list[bytes], int]:
        """The ids of each word as packed 32-bit numbers, and how many words were merged step by step."""
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(sizes)
        word, ids, _ = self.propose(np.frombuffer(b"".join(coded), np.uint8), ends - sizes, ends)
        pair = np.flatnonzero(word[1:] == word[:-1])
        failing = np.unique(word[pair[~self.compatible(ids[pair], ids[pair + 1])]]).tolist()
        packed, cut = ids.astype("<u4").tobytes(), (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        out = [packed[i:j] for i, j in zip(cut, cut[1:])]
        short = [k for k in failing if len(coded[k]) <= SIDE_BY_SIDE]
        for k, found in zip(short, self.merge_rows([coded[k] for k in short]) if short else []):
            out[k] = found.astype("<u4").tobytes()
        for k in failing:
            if len(coded[k]) > SIDE_BY_SIDE:
                out[k] = np.array(self.merge(coded[k]), "<u4").tobytes()
        return out, len(failing)


class Splitter:
    """Words of a text as the tokenizer takes them, added tokens as words of their own."""

    def __init__(self, added: dict[str, int]):
        self.narrow, self.wide = re.compile(narrow_pattern()), regex.compile(WORD_PATTERN)
        by_length = sorted(added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if added else None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.agree: dict[str, bool] = {}

    def agreed(self, c: str) -> bool:
        """Whether pattern and tokenizer, which may follow different Unicode versions, put a character into one class."""
        if c not in self.agree:
            probe = f"a{c}{c}b1{c}2 {c}.{c}. {c}  {c} x"
            theirs = [probe[i:j] for _, (i, j) in self.library.pre_tokenize_str(probe)]
            self.agree[c] = theirs == self.wide.findall(probe)
        return self.agree[c]

    def parts(self, text: str) -> Iterator[Iterator[str]]:
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            beyond = set() if k % 2 or part.isascii() else set(_BEYOND.findall(part))
            if k % 2:
                yield [part]
            elif not all(map(self.agreed, beyond)):
                yield (part[i:j] for _, (i, j) in self.library.pre_tokenize_str(part))
            else:
                pattern = self.wide if beyond else self.narrow
                yield pattern.findall(part) if len(part) < LONG_TEXT else (m[0] for m in pattern.finditer(part))

    def chunks(self, text: str, size: int) -> Iterator[tuple[list[str], bool]]:
        """Lists of words, the last one (maybe empty) marked; of at most ``size`` words if the text is long."""
        words = chain.from_iterable(self.parts(text))
        if len(text) < LONG_TEXT:
            yield list(words), True
            return
        while some := list(islice(words, size)):
            yield some, False
        yield [], True


class Encoder:
    """Encodes texts of one task; keeps the ids of words up to a bound."""

    def __init__(self, vocabulary: Vocabulary, cached: int = CACHED_WORDS, chunk: int = CHUNK_WORDS):
        self.vocabulary, self.cached, self.chunk = vocabulary, cached, chunk
        self.splitter = Splitter(vocabulary.added)
        self.known: dict[str, bytes] = {}
        self.forget()
        self.seen = self.merged = 0

    def forget(self) -> None:
        self.known = {content: array("I", [i]).tobytes() for content, i in self.vocabulary.added.items()}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.cached:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            ids, merged = self.vocabulary.encode_words(new)
            self.known.update(zip(new, ids))
            self.seen, self.merged = self.seen + len(new), self.merged + merged

    def encode(self, rows: Iterator[tuple[object, bytes | None]]) -> Iterator[tuple[object, np.ndarray, bool]]:
        """(key, some of its ids, whether they are its last) in the order of ``rows`` (key, text in UTF-8)."""
        waiting, held = [], 0
        for key, text in rows:
            for words, last in self.splitter.chunks((text or b"").decode("utf-8", "replace"), self.chunk):
                waiting.append((key, words, last))
                held += len(words) + 1
                if held >= self.chunk:
                    yield from self.release(waiting)
                    waiting, held = [], 0
        yield from self.release(waiting)

    def release(self, waiting: list[tuple[object, list[str], bool]]) -> Iterator[tuple[object, np.ndarray, bool]]:
        self.learn({w for _, words, _ in waiting for w in words})
        for key, words, last in waiting:
            yield key, np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4"), last


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """Text of ``ids`` in UTF-8, special ones spelled out; broken sequences become U+FFFD, ids without entry nothing."""
    pieces = vocabulary.pieces
    known = ids[(ids >= 0) & (ids < len(pieces))] if ids.dtype.kind == "i" else ids[ids < len(pieces)]
    return b"".join(map(pieces.__getitem__, known.tolist())).decode("utf-8", "replace").encode()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes | None]]:
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            yield key.as_py(), text.as_py()


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every text in order."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, parts, keys, ids, held = Encoder(vocabulary.value), [], [], [], 0
        for key, some, last in encoder.encode(_pairs(batches)):
            parts.append(some)
            held += len(some)
            if last:
                keys.append(key)
                ids.append(np.concatenate(parts).astype(np.int32))
                parts = []
            if keys and held > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])
                keys, ids, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "id long, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every list of ids; null ids are left out, a null list is an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                values = ids.values.drop_null().to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                texts.append(decode_ids(vocabulary.value, values).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    lists = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return lists.mapInArrow(run, "id long, text string").select(F.col("id").alias(id_col), "text")


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, words_new long, words_merged long"


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids of every text, digests of its ids and of the text that they decode to.

    ``words_new`` and ``words_merged`` tell, at the row that ended a group of texts, how many distinct words that group
    added and how many of them failed verification. Ids and decoded text stay in the task.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        names = list(map(str, range(len(vocabulary.value.pieces))))
        rows, count, told = [], 0, (0, 0)
        ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in ROUND_TRIP.split(", ")])

        for key, ids, last in encoder.encode(_pairs(batches)):
            if len(ids):
                ids_hash.update(("," * (count > 0) + ",".join(map(names.__getitem__, ids.tolist()))).encode())
                text_hash.update(decode_ids(vocabulary.value, ids))
                count += len(ids)
            if last:
                rows.append((key, count, ids_hash.hexdigest(), text_hash.hexdigest(), encoder.seen - told[0], encoder.merged - told[1]))
                count, told = 0, (encoder.seen, encoder.merged)
                ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
                if len(rows) >= 5_000:
                    yield batch()
        yield batch()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, ROUND_TRIP).withColumnRenamed("doc_id", id_col)


pickle_by_value(__name__)
