"""Harmonic packing of tokenised documents into fixed-length training sequences.

Every worker packs the documents of its own partition and nothing is shuffled. Pieces are put into classes by the
reciprocal of the share of a sequence that they fill: class k holds lengths in (capacity/(k+1), capacity/k], and a
sequence of class k takes exactly k pieces. A document is cut so that its large pieces fill their class exactly; only
what is left below capacity/``finest`` is packed with its true length, which leaves under 1/``finest`` of such a sequence
empty. What a worker has not filled at its end (fewer than k pieces a class, so a bounded number of ids) is laid end to
end, cut at the capacity, and its last part is cut into sequences of power-of-two length, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one; other columns are never
read; an empty table gives an empty result. Sequence numbers hold the partition in their upper bits, so the same
partitions give the same sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.session import pickle_by_value

CAPACITY = 4096
END_ID = 2
FINEST = 32
CACHED_WORDS = 500_000
_END = array("I", [END_ID]).tobytes()
#: The place between an ASCII letter or digit and a mark behind it.
_MARK = re.compile(rb"(?<=[a-z0-9])(?=[.,;:!?*#$%&|<>()=])")
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Words(dict):
    """Packed ids of pieces of text without white space, kept up to a bound.

    The tokenizer folds case, drops white space and never joins a letter or digit with a mark behind it, so the ids of a
    text are those of its pieces in order, and pieces may be folded and cut there to repeat more often. Texts that spell
    a special token are cut at white space only.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, piece: bytes) -> bytes:
        ids = array("I", self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def ids(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        pieces = text.split() if b"<|" in text else _MARK.sub(b" ", text.lower()).split()
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)) + _END, dtype="<u4")


def cut_lengths(length: int, capacity: int, finest: int) -> list[int]:
    """Lengths of the pieces of a document: whole sequences, then exact reciprocals, then a small rest."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = -(-capacity // rest)  # the least k for which capacity / k fits into the rest
        size = capacity // k
        if k > finest:
            pieces.append(rest)
            break
        pieces.append(size)
        rest -= size
    return pieces


class Bins:
    """The sequences of one worker."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next, self.open = capacity, worker << 32, {}
        self.rows: list[tuple] = []

    def add(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        k = self.capacity // len(ids)
        waiting = self.open.setdefault(k, [])
        waiting.append((doc, start, ids, total))
        if len(waiting) == k:
            self.emit(self.open.pop(k))

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def close(self) -> None:
        """Pack what fills no sequence of its class: end to end, the last part in lengths that are powers of two."""
        waiting = [p for k in sorted(self.open) for p in self.open.pop(k)]
        left = sum(len(p[2]) for p in waiting)
        sizes = [self.capacity] * (left // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if (left % self.capacity) >> b & 1]
        k = 0
        for size in sizes:
            taken = []
            while size:
                doc, start, ids, total = waiting[k]
                n = min(size, len(ids))
                taken.append((doc, start, ids[:n], total))
                size -= n
                waiting[k] = (doc, start + n, ids[n:], total)
                k += n == len(ids)
            self.emit(taken)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(FIELDS))


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, finest: int = FINEST
) -> DataFrame:
    """One row per piece: its document, place, length, checksum, and its sequence and offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins = Words(tokenizer_path), Bins(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, start = words.ids(text.as_py()), 0
                for n in cut_lengths(len(ids), capacity, finest):
                    # A copy, so that a waiting piece does not hold the ids of its whole document.
                    bins.add(doc, start, ids[start : start + n].copy(), len(ids))
                    start += n
                if len(bins.rows) >= 20_000:
                    yield bins.batch()
        bins.close()
        yield bins.batch()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, SCHEMA)


pickle_by_value(__name__)
