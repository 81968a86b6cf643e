"""LM scoring by cross-entropy difference (Moore and Lewis): how much better a target model fits a document.

Two bigram models share one vocabulary, one order and one smoothing: the target model is counted over the
documents labelled as good, the background model over all documents. A document's score is the mean over its
tokens of the target model's loss less the background model's; lower is closer to the target.
p(w | v) = a c(v w)/c(v) + (1-a) p(w) if c(v) > 0 and v is a context, else p(w), with p(w) = (c(w)+1)/(N+V).

A document is never scored by its own counts: what it adds to c(w), N, c(v w) and c(v) by w or by the pair itself is
taken out again, in the background model and, for target documents, in the target model. So the two models
are matched although one is counted on part of what it scores, and a text that stands twice in the corpus
shows, as its copy is counted and it isn't.

Every word is in the vocabulary and a context, whatever its count; words and pairs are known by hashes of 63 bits. A
caller may name a share under which a word is no context: after such a word the models back off to p(w).

Documents are dealt in units of a bounded number of tokens. A unit sends its distinct words and pairs, with its own
counts of them, to parts: ranges of the hashes, whose number grows with the corpus. A part adds up what all units sent and
answers each unit in the order in which it asked; then the unit, whose tokens came along, has all counts and scores its documents.
A word or pair stands once in a unit, so however frequent it is, a part sees it no more often than there are units. Nothing
that grows with the corpus is broadcast or sent to the driver.

Defined results: null and empty texts have no tokens, losses and score 0; a document labelled more than once
is a target if any label says so; without targets the target model is uniform; repeated rows count and
score one by one; an empty table gives an empty one; extra columns are not looked at.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import shipped, stored_alone

START = 1
#: Weight of the pairs.
WEIGHT = 0.7
#: Tokens of a part (at `CHARS` characters), tokens of a unit (documents that are dealt together).
PART, UNIT, CHARS = 2_000_000, 1_000_000, 6
#: Hashes of a part that are added up at once, tokens of a unit whose losses are taken at once.
RANGE, SLICE = 100_000, 100_000
#: Labelled ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST = 1 << 21


class Hasher:
    """Texts to hashes of their words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def tokens(self, text: str | None) -> list[int]:
        known, out = self.known, []
        if len(known) > 200_000:
            known.clear()
        for w in (text or "").lower().split():
            h = known.get(w)
            if h is None:
                h = max(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1, 2)
                if len(w) <= 64:
                    known[w] = h
            out.append(h)
        return out


def _pack(x: np.ndarray) -> bytes:
    """Numbers as bytes: the first bytes of all, then the second ones and so on, so that small numbers take little."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return x.dtype.char.encode() + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(x: bytes) -> np.ndarray:
    kind, n = np.dtype(x[:1].decode()), int.from_bytes(x[1:9], "little")
    planes = np.frombuffer(pa.decompress(x[9:], n, "zstd", asbytes=True) if n else b"", dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel() if n else np.empty(0, dtype=kind)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, good): whether a label says that the document is good."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id", F.lit(True).alias("good")).distinct()
    good = F.broadcast(good) if good.count() <= BROADCAST else good
    return docs.select("doc_id", "text").join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))


def _mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """63-bit hashes of pairs of hashes (steps of splitmix64)."""
    z = v.astype(np.uint64)
    z *= np.uint64(0x9E3779B97F4A7C15)
    z ^= w.view(np.uint64)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z >>= np.uint64(1)
    return z.view(np.int64)


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each among them (in less memory than `np.unique` takes for both)."""
    every = np.unique(x)
    return every, np.searchsorted(every, x).astype(np.int32)


@dataclass
class Unit:
    """The tokens of some documents. Words are places in `words` (in order, START first), pairs places in `pairs`."""

    sizes: np.ndarray  # tokens of a document
    good: np.ndarray  # of a document
    words: np.ndarray  # hashes
    w: np.ndarray  # the word of a token

    def __post_init__(self):
        sizes, w = self.sizes, self.w
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.v = np.roll(w, 1)
        self.v[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        self.pairs, self.pair = _places(_mixed(self.words[self.v], self.words[w]))
        self.before, self.word = np.empty((2, len(self.pairs)), dtype=np.int32)
        self.before[self.pair], self.word[self.pair] = self.v, w

    def word_counts(self) -> np.ndarray:
        """As a token and as a context, in all and in target documents."""
        aimed = self.good[self.row].astype(np.float64)
        return np.stack([np.bincount(x, y, len(self.words)) for y in (None, aimed) for x in (self.w, self.v)]).astype(np.int64)

    def pair_counts(self) -> np.ndarray:
        aimed = self.good[self.row].astype(np.float64)
        return np.stack([np.bincount(self.pair, y, len(self.pairs)) for y in (None, aimed)]).astype(np.int64)

    def losses(self, words: np.ndarray, pairs: np.ndarray, size: int, totals: tuple[int, int], contexts: int | None) -> np.ndarray:
        """Background and target loss of each document, from the counts of words and pairs in all units."""
        out, ends, lo = np.zeros((2, len(self.sizes))), np.cumsum(self.sizes), 0
        while lo < len(ends):
            begin = int(ends[lo] - self.sizes[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
            at = slice(begin, int(ends[hi - 1]))
            if at.stop > begin:
                out[:, lo:hi] = self._losses(lo, hi, at, words, pairs, size, totals, contexts)
            lo = hi
        return out

    def _losses(self, lo: int, hi: int, at: slice, words: np.ndarray, pairs: np.ndarray, size: int, totals: tuple[int, int], contexts: int | None) -> list[np.ndarray]:
        """Those of the documents from `lo` to `hi`, whose tokens are `at`."""
        key, times = np.unique((self.row[at].astype(np.int64) - lo) * len(self.pairs) + self.pair[at], return_counts=True)
        row, pair = np.divmod(key, len(self.pairs))
        w, v, good = self.word[pair], self.before[pair], self.good[row + lo]
        own, mine = np.unique(row * len(self.words) + w, return_inverse=True)
        own = np.bincount(mine, times, len(own))[mine]
        often = np.ones(len(w), dtype=bool) if contexts is None else (v == 0) | (words[1][v] * contexts >= totals[0])
        out = []
        for k, out_of in ((0, np.ones(len(w), dtype=bool)), (1, good)):  # counted in this model, so taken out again
            less, twice = own * out_of, times * out_of
            low = (words[2 * k][w] - less + 1.0) / (totals[k] - less + size)
            before = words[2 * k + 1][v] - twice
            high = np.where(before > 0, (pairs[k][pair] - twice) / np.maximum(before, 1), low)
            loss = -np.log(np.where(often, WEIGHT * high + (1 - WEIGHT) * low, low)) * times
            out.append(np.bincount(row, loss, hi - lo))
        return out


def _release() -> None:
    """Gives freed memory back to the system: idle Python workers would keep it beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def _short(x: np.ndarray) -> bytes:
    return _pack(x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x)


def _add_up(hashes: list[np.ndarray], counts: list[np.ndarray]) -> int:
    """Puts the sums over all units in place of each unit's own counts (rows of `counts`); the number of hashes with a token.

    `hashes` are ascending and stand once in a unit. Range after range of them is added up, so that little is held beside them."""
    kind = np.uint32 if sum(int(x.sum(dtype=np.int64)) for x in counts) < 1 << 32 else np.int64
    counts[:] = [x.astype(kind) for x in counts]
    low, high = min(int(x[0]) for x in hashes), max(int(x[-1]) for x in hashes)
    ranges = max(1, sum(map(len, hashes)) // RANGE)
    cuts = low + (high - low) // ranges * np.arange(1, ranges)
    spans = [[0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in hashes]
    size = 0
    for k in range(ranges):
        some = [slice(x[k], x[k + 1]) for x in spans]
        edges = np.cumsum([0, *(x.stop - x.start for x in some)])
        every, place = np.unique(np.concatenate([x[at] for x, at in zip(hashes, some, strict=True)]), return_inverse=True)
        sums = np.zeros((len(counts[0]), len(every)), dtype=kind)
        for x, at, lo, hi in zip(counts, some, edges, edges[1:], strict=False):
            sums[:, place[lo:hi]] += x[:, at]
        for x, at, lo, hi in zip(counts, some, edges, edges[1:], strict=False):
            x[:, at] = sums[:, place[lo:hi]]
        size += int((sums[0] > 0).sum())
    return size


#: Rows of words and of pairs (a: hashes, b: counts), of a unit's tokens (ids; b: places, c: sizes, d: whether
#: good; n and tn: tokens, in all and in target documents) and of a part's vocabulary (n: its size).
WORDS, PAIRS, HEAD, SIZE = range(4)
NAMES = ["bucket", "unit", "kind", "ids", "a", "b", "c", "d", "n", "tn"]


@dataclass
class Model:
    """Counts over the documents that are to be scored."""

    met: DataFrame  # the units and the counts that they asked for
    doc_id: str  # type of the ids
    size: int  # of the vocabulary
    totals: tuple[int, int]  # tokens, in all and in target documents
    contexts: int | None


def fit(docs: DataFrame, labels: DataFrame, contexts: int | None = None) -> Model:
    """`docs`: doc_id, text. `labels`: doc_id, quality. With `contexts` only words of one in so many tokens are contexts."""
    from pyspark.sql.pandas.types import to_arrow_type

    table = marked(docs, labels)
    id_type = table.schema["doc_id"].dataType
    kind = id_type.simpleString()
    arrow = pa.schema(list(zip(NAMES, [pa.int64(), pa.int64(), pa.int32(), pa.list_(to_arrow_type(id_type)), *[pa.binary()] * 4, pa.int64(), pa.int64()], strict=True)))
    packed = f"bucket long, unit long, kind int, ids array<{kind}>, a binary, b binary, c binary, d binary, n long, tn long"
    # Only the number of parts hangs on it, no result.
    parts = max(1, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // (CHARS * PART))

    def asked(name: int, what: int, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        # Parts are ranges of the hashes, so in this order each part's entries stand together.
        edges = np.searchsorted(((hashes >> 31) * parts) >> 32, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[p], edges[p + 1])
            yield (p, name, what, None, _pack(np.diff(hashes[at], prepend=0)), _short(counts[:, at].ravel()), None, None, None, None)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, task, unit = Hasher(), TaskContext.get().partitionId(), 0
        ids, sizes, good, flat, tokens = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            name = task << 32 | unit
            words, w = _places(np.concatenate([np.array([START]), *flat]))
            u = Unit(np.array(sizes, dtype=np.int64), np.array(good, dtype=bool), words, w[1:])
            rows = [(unit % parts, name, HEAD, list(ids), None, _pack(u.w.astype(np.uint32)), _short(u.sizes), _pack(u.good.astype(np.uint8)), len(u.w), int(u.sizes[u.good].sum()))]
            if len(u.w):
                rows += [*asked(name, WORDS, words, u.word_counts()), *asked(name, PAIRS, u.pairs, u.pair_counts())]
            return _rows(rows, arrow)

        for b in batches:
            for doc_id, text, aimed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found = np.array(hasher.tokens(text), dtype=np.int64)
                ids.append(doc_id)
                sizes.append(len(found))
                good.append(aimed)
                flat.append(found)
                tokens += len(found)
                if tokens >= UNIT:
                    yield out()
                    for held in (ids, sizes, good, flat):
                        held.clear()
                    tokens, unit = 0, unit + 1
        if ids:
            yield out()
        del hasher
        _release()

    def meet(t: pa.Table) -> pa.Table:
        kinds, bucket, rows = t["kind"].to_numpy(), t["bucket"][0].as_py(), []
        heads = t.filter(pa.array(kinds == HEAD)).select(NAMES).cast(arrow)
        for what, width in ((WORDS, 4), (PAIRS, 2)):
            at = np.flatnonzero(kinds == what).tolist()
            if not at:
                continue
            counts = [_unpack(t["b"][k].as_py()).reshape(width, -1) for k in at]
            size = _add_up([np.cumsum(_unpack(t["a"][k].as_py())) for k in at], counts)
            for k, x in zip(at, counts, strict=True):
                rows.append((bucket, t["unit"][k].as_py(), what, None, t["a"][k].as_py() if what == WORDS else None, _short(x.ravel()), None, None, None, None))
            if what == WORDS:
                rows.append((bucket, None, SIZE, None, None, None, None, None, size, None))
            del counts
        out = pa.Table.from_batches([*heads.to_batches(), _rows(rows, arrow)], arrow)
        _release()
        return out

    met = stored_alone(table.transform(shipped).mapInArrow(deal, packed).groupBy("bucket").applyInArrow(meet, packed))
    n, tn, size = met.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0)) for k, c in ((HEAD, "n"), (HEAD, "tn"), (SIZE, "n"))]).first()
    return Model(met, kind, size, (n, tn), contexts)


def score(model: Model) -> DataFrame:
    """(doc_id, n_tokens, background_loss, target_loss, score) for each document of the model."""
    size, totals, contexts = model.size, model.totals, model.contexts

    def finish(t: pa.Table) -> pa.Table:
        kinds = t["kind"].to_numpy()
        head = t.filter(pa.array(kinds == HEAD))
        w, sizes, good = (_unpack(head[k][0].as_py()) for k in "bcd")
        some = t.filter(pa.array(kinds == WORDS)).sort_by("bucket")
        words = np.concatenate([np.empty(0, dtype=np.int64), *(np.cumsum(_unpack(x.as_py())) for x in some["a"])])
        u = Unit(sizes.astype(np.int64), good.astype(bool), words, w.astype(np.int32))

        def answer(what: int, width: int) -> np.ndarray:
            some = t.filter(pa.array(kinds == what)).sort_by("bucket")
            return np.concatenate([np.zeros((width, 0), dtype=np.int64), *(_unpack(x.as_py()).reshape(width, -1).astype(np.int64) for x in some["b"])], axis=1)

        low, high = (x / np.maximum(u.sizes, 1) for x in u.losses(answer(WORDS, 4), answer(PAIRS, 2), size, totals, contexts))
        _release()
        return pa.table({"doc_id": head["ids"].combine_chunks().flatten(), "n_tokens": u.sizes, "background_loss": low, "target_loss": high, "score": high - low})

    asked = model.met.filter(F.col("kind") != SIZE)
    return asked.groupBy("unit").applyInArrow(finish, f"doc_id {model.doc_id}, n_tokens long, background_loss double, target_loss double, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(fit(docs, labels))
