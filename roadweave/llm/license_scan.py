"""License scan as an exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of ``BLOCK`` words, every ``BLOCK / 2`` words one. The tokens of the templates get a
global order by their frequency in the whole corpus, rarest first. A block can only contain ``THRESHOLD`` of a template's
tokens if it holds one of the template's first size - needed + 1 tokens (prefix filter); it must have as many distinct
tokens as are needed (length filter), and each prefix token found bounds what the rest can still add (positional filter).
What passes is compared exactly. The templates are a bounded parameter and go to the tasks; no pair of documents is built.

Phrase rules find the named licenses by consecutive words at every place of the text.

Defined results: a null or empty text has no words, no place (null first and last word), empty labels and score 0; a text
shorter than a block is one block; repeated rows are scanned one by one; other columns are never read; an empty table gives
an empty result. Words fold A-Z only and keep every character outside ASCII.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.session import pickle_by_value

BLOCK = 48
THRESHOLD = 0.8

# Phrases of consecutive words and their labels.
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

# Opening statements of common licenses and the labels they give.
TEMPLATES = (
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Bytes that are no word characters become spaces, A-Z are folded; bytes of characters outside ASCII stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents hold each template token: a count over all documents of a bounded set of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(vocabulary.intersection(tokens(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    counted = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "token binary, n long")
    return {bytes(r[0]): r[1] for r in counted.groupBy("token").agg(F.sum("n")).collect()}


class Join:
    """The template side of the join: tokens by rank, sizes needed, and an index of the prefix tokens."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], threshold: float):
        self.labels = [label for label, _ in templates]
        self.sets = [frozenset(tokens(t.encode())) for _, t in templates]
        self.need = [-(-round(len(s) * threshold * 1000) // 1000) for s in self.sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sets):
            ordered = sorted(s, key=lambda t: (frequency.get(t, 0), t))
            for place, t in enumerate(ordered[: len(s) - self.need[k] + 1]):
                self.prefix.setdefault(t, []).append((k, place))
        self.rare = frozenset(self.prefix)

    def best(self, words: list[bytes], block: int) -> dict[int, float]:
        """Per template the largest containment over the blocks that meet the threshold."""
        held = self.rare.intersection(words)
        if not held:
            return {}
        step, found, last = block // 2, {}, max(0, len(words) - block)
        starts: dict[int, set[bytes]] = {}
        for i, w in enumerate(words):
            if w in held:
                low = max(0, -(-(i - block + 1) // step))
                for b in range(low, i // step + 1):
                    starts.setdefault(min(b * step, last), set()).add(w)
        for start, hits in starts.items():
            have = frozenset(words[start : start + block])
            for k in {k for t in hits for k, _ in self.prefix[t]}:
                size, need = len(self.sets[k]), self.need[k]
                first = min(p for t in hits for j, p in self.prefix[t] if j == k)
                if len(have) < need or size - first < need:
                    continue
                common = len(have & self.sets[k])
                if common >= need:
                    found[k] = max(found.get(k, 0.0), common / size)
        return found


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where the words of a phrase stand one after the other."""
    found = []
    for phrase, label in PHRASES:
        parts = [p.encode() for p in phrase]
        rest, i = parts[1:], -1
        try:
            while True:
                i = words.index(parts[0], i + 1)
                if words[i + 1 : i + len(parts)] == rest:
                    found.append((i, label))
        except ValueError:
            pass
    return found


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """One row per document: phrase places, labels of phrases and of template blocks, and the best containment."""
    vocabulary = frozenset(t for _, text in templates for t in tokens(text.encode()))
    join = Join(templates, frequencies(docs, text_col, vocabulary), threshold)

    def row(doc: int, text: bytes | None) -> tuple:
        words = tokens(text)
        found = places(words)
        starts, base = [i for i, _ in found], {label for _, label in found}
        matched = join.best(words, block)
        labels = base | {join.labels[k] for k in matched}
        score = 1.0 if found else max(matched.values(), default=0.0)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return doc, len(words), len(found), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score

    kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64())
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(d, t.as_py()) for d, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, SCHEMA)


pickle_by_value(__name__)
