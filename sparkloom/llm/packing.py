"""Harmonic packing of token sequences into bins of a fixed capacity, independently in each partition.

A sequence of the reciprocal class k holds exactly k pieces of a k-th of the capacity each, so it is full after a
fixed count, whatever arrives in between. A document's ids and one closing id are cut to these lengths: whole
capacities first (class 1), then the largest k-th that fits into what is left, and so on, down to `min_piece`
ids. (Where k does not divide the capacity, a class's pieces differ by one, so that k of them fill the sequence.)
What is left under `min_piece` is not cut: a tail of n ids belongs to class k = capacity // n, that is
capacity/(k+1) < n <= capacity/k, and k tails of its class share a sequence. With `min_piece` = capacity
no remainder is cut: plain harmonic packing.

A partition's open sequences at its end (at most one for each class) are joined and cut freely into whole
capacities and then powers of two, so that they need no padding. No shuffle: each partition packs alone, and
a sequence id is the partition's number in the upper bits and a count in the lower 40. State is bounded by
the open sequences, whatever the partition's size, besides one document's ids.

Defined results: a null text counts as empty and gives the closing id alone; repeated rows are packed one
by one; null ids stay null; an empty table gives an empty table; extra columns are not looked at. Texts
over a million characters are encoded in parts, cut where the vocabulary never joins; runs of whitespace of any
length are merged apart.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import byte_bpe
from sparkloom.session import shipped

COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def slot(capacity: int, k: int, j: int) -> int:
    """The length of piece j (from 0) of a sequence of k pieces."""
    return capacity * (j + 1) // k - capacity * j // k


class Packer:
    """Pieces in, rows out: (doc, start, length, crc32 of the ids, doc's tokens, sequence, offset)."""

    def __init__(self, capacity: int, min_piece: int, first: int):
        self.capacity, self.min_piece, self.next = capacity, min_piece, first
        #: Open sequences by class: those of cut pieces (True) and of tails (False).
        self.open: dict[tuple[bool, int], list] = defaultdict(list)

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, part, total in pieces:
            yield doc, start, len(part), zlib.crc32(part.tobytes()), total, self.next, offset
            offset += len(part)
        self.next += 1

    def _next(self, left: int) -> tuple[bool, int, int]:
        """(cut, class, length) of the next piece of what is left of a document."""
        if left < min(self.min_piece, self.capacity):
            return False, self.capacity // left, left
        k = -(-self.capacity // left)
        while (n := slot(self.capacity, k, len(self.open[True, k]))) > left:
            k += 1
        return True, k, n

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            cut, k, n = self._next(len(ids) - at)
            # A copy, so that an open piece does not hold its whole document.
            self.open[cut, k].append((doc, at, ids[at : at + n].copy() if k > 1 else ids[at : at + n], len(ids)))
            at += n
            if len(self.open[cut, k]) == k:
                yield from self._close(self.open.pop((cut, k)))

    def finish(self) -> Iterator[tuple]:
        """What is open (a sequence a class at most), in one row, cut into whole capacities and then powers of two."""
        row = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) for p in row)
        row.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            room, left, pieces = min(room, self.capacity), left - min(room, self.capacity), []
            while room:
                doc, start, part, total = row.pop()
                if len(part) > room:
                    row.append((doc, start + room, part[room:], total))
                    part = part[:room]
                pieces.append((doc, start, part, total))
                room -= len(part)
            yield from self._close(pieces)
        self.open.clear()


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, min_piece: int = 46) -> DataFrame:
    """One row for each piece of each document of `docs` (doc_id, text); see the module's text."""
    path = tokenizer or byte_bpe.default_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, min_piece, TaskContext.get().partitionId() << 40)
        kind, rows = pa.int64(), []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", *COLUMNS])

        for b in batches:
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(byte_bpe.ids(path, text.as_py() or ""), np.array([end_id], dtype="<u4"))
                rows.extend(packer.add(doc, ids))
                if len(rows) >= 20_000:
                    yield out()
        rows.extend(packer.finish())
        if rows:
            yield out()

    return docs.select("doc_id", F.col("text")).transform(shipped).mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"`{c}` long" for c in COLUMNS))
