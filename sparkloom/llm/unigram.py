"""Unigram tokenization of a public SentencePiece vocabulary: counts alone, and encoding with decoding.

Both take a text as SentencePiece does: blanks become the marker U+2581, one marker is put in front, and the
pieces are chosen by the largest sum of log scores (Viterbi). The tie rule is the usual one: the end of a
piece takes a new best path only if its score is strictly larger, and starts are tried from the left, so of
equal paths the one whose last piece is longest wins. A character that no piece of one character covers
may also stand alone, at the vocabulary's lowest score less 10, and is written as one piece for each of its
UTF-8 bytes. User-defined pieces score their bytes times the highest score, less 0.1. Scores are added in
double precision, as the Unigram model of `tokenizers` does, whose ids these are (tests compare them);
`sentencepiece` adds in single precision, so its choices may differ where sums are large.

No piece holds a marker after another character, and none holds a line break, so the best path of a text is
made of the best paths of its chunks between those places (checked against the vocabulary when it is
loaded; without it a text is one chunk). Paths of chunks of at most `LONGEST` characters are remembered in two generations of bounded size.

* `TokenCounter`: an Aho-Corasick automaton lists all matches; the dynamic programme carries score and count.
* `Codec`: a double-array trie over the pieces' bytes, back pointers, byte fallback, and decoding.

One pass over the documents, no shuffle; the vocabulary's tables are bounded by its size. Null texts count
as empty and have no pieces; repeated rows are handled one by one; empty tables give empty ones; extra
columns are not looked at. In decoding, a marker in the original text comes back as a blank, as with the
libraries.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import shipped

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
GENERATION = 200_000
#: Characters of a chunk that is remembered: longer ones (unspaced scripts, encoded data) hardly come again.
LONGEST = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


class Vocabulary:
    """Pieces with ids and scores, as the Viterbi search needs them."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        normal = [s for _, s, t in pieces if t == NORMAL]
        high, self.unknown_score = max(normal, default=0.0), min(normal, default=0.0) - 10.0
        self.scored = {p: (len(p.encode()) * high - 0.1 if t == USER else s, i) for i, (p, s, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        apart = not any(MARK in p.lstrip(MARK) for p in self.scored)
        lines = not any("\n" in p for p in self.scored)
        self.chunks = re.compile("%s*[^%s\n]+|%s+|\n" % (MARK, MARK, MARK) if apart and lines else "(?s).+").findall

    def split(self, text: str) -> list[str]:
        return self.chunks(MARK + text.replace(" ", MARK)) if text else []


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file; cached in each worker."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces = []
    for field, value in _fields(raw):
        if field == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return Vocabulary(pieces)


class Remembered:
    """A function of a string with its last results, in two generations of bounded size."""

    def __init__(self, make: Callable, size: int = GENERATION):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def all(self, keys: list[str]) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.one(keys[i])
        return found

    def one(self, key: str):
        x = self.young.get(key)
        if x is None:
            x = self.old.get(key)
            if x is None:
                x = self.make(key)
            if len(key) <= LONGEST:
                if len(self.young) >= self.size:
                    self.old, self.young = self.young, {}
                self.young[key] = x
        return x


class TokenCounter:
    """Best score and number of pieces, without the pieces."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary, self.automaton = vocabulary, ahocorasick.Automaton()
        for piece, (score, _) in vocabulary.scored.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.paths = Remembered(self.chunk)

    def chunk(self, text: str) -> tuple[float, int]:
        """Matches come by their ends and, at one end, from the longest, which is the order of starts."""
        n, unknown = len(text), self.vocabulary.unknown_score
        best, count, single, done = [float("-inf")] * (n + 1), [0] * (n + 1), bytearray(n + 1), 0
        best[0] = 0.0

        def close(end: int) -> None:
            """Ends up to `end` take the unknown character, where no single piece covers it."""
            nonlocal done
            while done < end:
                done += 1
                if not single[done] and best[done - 1] + unknown > best[done]:
                    best[done] = best[done - 1] + unknown
                    count[done] = count[done - 1] + len(text[done - 1].encode("utf-8", "surrogatepass"))

        for last, (size, score) in self.automaton.iter(text):
            if done < last:
                close(last)
            start, end = last + 1 - size, last + 1
            if best[start] + score > best[end]:
                best[end] = best[start] + score
                count[end] = count[start] + 1
            if size == 1:
                single[end] = 1
        close(n)
        return best[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        found = self.paths.all(self.vocabulary.split(text))
        return (sum(x[0] for x in found), sum(x[1] for x in found)) if found else (0.0, 0)


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of s by byte c is base[s] + c + 1 if check there is s; value -1: no key ends."""
    tree: dict = {}
    for key, value in keys.items():
        node = tree
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    size = 1 << 20
    base, check, value, used = [0] * size, [-1] * size, [-1] * size, bytearray(size)
    used[0], low, queue = 1, 1, [(0, tree)]
    for s, node in queue:
        value[s] = node.get(-1, -1)
        children = sorted(c for c in node if c >= 0)
        if not children:
            continue
        first, slot, tries = children[0], max(low, children[0] + 1), 0
        while True:
            slot = used.find(0, slot)
            if slot < 0 or slot + 512 > size:
                slot = size - 600 if slot < 0 else slot
                base, check, value, used, size = base + [0] * size, check + [-1] * size, value + [-1] * size, used + bytearray(size), 2 * size
                continue
            at = slot - first - 1
            if not any(used[at + c + 1] for c in children):
                break
            slot, tries = slot + 1, tries + 1
        if tries > 100:  # the slots before are too scattered to look at again
            low = slot
        base[s] = at
        for c in children:
            check[at + c + 1], used[at + c + 1] = s, 1
            queue.append((at + c + 1, node[c]))
    top = size - len(used) + used.rfind(1) + 512
    return tuple(np.array(x[:top], dtype=np.int32) for x in (base, check, value))


class Codec:
    """Texts to ids and back."""

    def __init__(self, vocabulary: Vocabulary, trie: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.vocabulary = vocabulary
        self.base, self.check, self.value = (a.tolist() for a in trie or self.build(vocabulary))
        self.score = [0.0] * len(vocabulary.pieces)
        for score, i in vocabulary.scored.values():
            self.score[i] = score
        self.paths = Remembered(self.chunk)

    @staticmethod
    def build(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return double_array({p.encode(): i for p, (_, i) in vocabulary.scored.items()})

    def chunk(self, text: str) -> bytes:
        """The ids of the best path, as little-endian unsigned 32-bit numbers."""
        raw = text.encode("utf-8", "surrogatepass")
        n, base, check, value, score = len(raw), self.base, self.check, self.value, self.score
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0], start = 0.0, 0
        while start < n:
            c = raw[start]
            width = 1 if c < 128 else 2 if c < 224 else 3 if c < 240 else 4
            here, node, single = best[start], 0, False
            for at in range(start, n):
                child = base[node] + raw[at] + 1
                if check[child] != node:
                    break
                node = child
                i = value[node]
                if i >= 0:
                    end = at + 1
                    single = single or end - start == width
                    if here + score[i] > best[end]:
                        best[end], back[end] = here + score[i], (start, i)
            end = start + width
            if not single and here + self.vocabulary.unknown_score > best[end]:
                best[end], back[end] = here + self.vocabulary.unknown_score, (start, -1)
            start = end
        ids: list[int] = []
        while n:
            start, i = back[n]
            ids.extend((i,) if i >= 0 else [self.vocabulary.bytes.get(b, self.vocabulary.unknown) for b in reversed(raw[start:n])])
            n = start
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.paths.all(self.vocabulary.split(text))), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        parts = self._bytes()
        raw = b"".join(map(parts.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw.startswith(b" ") else raw.decode("utf-8", "replace")

    @functools.cache  # noqa: B019  one table for each codec, and there is one codec
    def _bytes(self) -> list[bytes]:
        out = [b"" if t in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, t in self.vocabulary.pieces]
        for b, i in self.vocabulary.bytes.items():
            out[i] = bytes([b])
        return out


_tools: dict = {}


def _tool(kind: type, path: str, *more):
    """One counter or codec for each worker, whose memory outlives a task."""
    if (kind, path) not in _tools:
        _tools.clear()
        _tools[kind, path] = kind(load(path), *more)
    return _tools[kind, path]


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, score) of each document of `docs` (doc_id, text)."""
    path, kind = model or default_path(), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _tool(TokenCounter, path)
        for b in batches:
            found = [counter.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], ["doc_id", "n_pieces", "score"])

    return docs.select("doc_id", F.col("text")).transform(shipped).mapInArrow(run, f"doc_id {kind}, n_pieces long, score double")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of each document of `docs` (doc_id, text)."""
    return _coded(docs, model, "ids array<int>", lambda codec, text: (codec.encode(text).astype(np.int32),), [pa.list_(pa.int32())])


def _coded(docs: DataFrame, model: str | None, schema: str, make: Callable, types: list) -> DataFrame:
    path, kind = model or default_path(), docs.schema["doc_id"].dataType.simpleString()
    trie = Codec.build(load(path))
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _tool(Codec, path, trie)
        for b in batches:
            rows = [make(codec, t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", *names])

    return docs.select("doc_id", F.col("text")).transform(shipped).mapInArrow(run, f"doc_id {kind}, {schema}")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of each row of `rows` (doc_id, ids); null ids give an empty text."""
    path, kind = model or default_path(), rows.schema["doc_id"].dataType.simpleString()
    trie = Codec.build(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _tool(Codec, path, trie)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(np.array(x or [], dtype="<u4")) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").transform(shipped).mapInArrow(run, f"doc_id {kind}, text string")


def _digest(codec: Codec, text: str) -> tuple:
    ids = codec.encode(text)
    back = codec.decode(ids)
    return len(ids), zlib.crc32(ids.tobytes()), len(back), back == text.replace(MARK, " ")


def query_codec(docs: DataFrame) -> DataFrame:
    """For each document its number of ids, their CRC-32 (little-endian unsigned 32-bit), and whether decoding gives the text back."""
    return _coded(docs, None, "n_ids long, ids_crc32 long, decoded_chars long, round_trip boolean", _digest, [pa.int64(), pa.int64(), pa.int64(), pa.bool_()])
