"""Approximate nearest neighbours by largest inner product: a forest of sorted hash strings (LSH Forest).

Each of `TREES` trees gives a vector a string of `BITS` bits, the sides of random hyperplanes it lies on
(vectors are first put on a sphere by one more component, so that the nearest by angle are the nearest by
inner product). A tree is the array of its strings in order; the vectors that share a prefix of x bits with
a query stand together. A search descends each tree to the query's longest match and then goes up all
trees by one bit at a time, together, until the candidates they hold reach the budget; that depth is taken
for each query from a bounded sample of strings (`SAMPLE` rows, the first by a hash of their ids).

The budget is set on the data: for `PROBES` queries of the sample the true neighbours are found by one pass
over all rows, and the smallest budget is taken whose candidates hold `target` of them (2k rows a tree at
least).

Spark's part: a tree is dealt into cells of about `CELL` vectors by the first p bits. A query goes to the
cell of its prefix, or to all cells below it if its depth is less than p. Cells with more than `LIMIT`
vectors are split by a hash of their ids, and queries to all parts. In a task a cell is the sorted array,
and queries of one prefix are scored against its range together. Each row meets only the queries of its
cells, every row is indexed, and nothing that grows with the data is broadcast or brought to the driver.

Defined results: vectors that are null, empty, zero, of another length than most, or hold nulls or
non-finite numbers take no part; rows with an id equal to the query's are its own; rows that repeat id and
score count once; null ids take no part; an empty table gives an empty one; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import cut, shipped

TREES, BITS = 32, 40
SAMPLE, PROBES = 4096, 64
CELL, LIMIT = 1024, 4096


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """What every task knows: hyperplanes, the largest norm, the sample's strings and the budget."""

    def __init__(self, sample: np.ndarray, rows: int, norm: float, seed: int = 17):
        self.norm, self.rows = norm, rows
        self.planes = np.random.default_rng(seed).standard_normal((sample.shape[1] + 1, TREES * BITS))
        self.sorted = np.sort(self.strings(sample), axis=0)
        self.depth = min(BITS, max(0, round(np.log2(max(rows, 1) / CELL))))
        self.budget = float("inf")

    def strings(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """[rows, trees] strings as whole numbers. Queries lie on the sphere without the extra component."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        sides = (np.column_stack([x, rest]) @ self.planes > 0).reshape(len(x), TREES, BITS)
        return sides @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def held(self, strings: np.ndarray) -> np.ndarray:
        """[queries, BITS+1]: how many rows all trees hold at each depth, from the sample."""
        found = np.zeros((len(strings), BITS + 1))
        for depth in range(BITS + 1):
            low = strings >> (BITS - depth) << (BITS - depth)
            for t in range(TREES):
                column = self.sorted[:, t]
                found[:, depth] += np.searchsorted(column, low[:, t] + (1 << (BITS - depth))) - np.searchsorted(column, low[:, t])
        return found * (self.rows / max(1, len(self.sorted)))

    def depths(self, strings: np.ndarray, budget: float | None = None, held: np.ndarray | None = None) -> np.ndarray:
        """The deepest depth, common to all trees, at which they hold the budget; 0 if none does."""
        enough = (self.held(strings) if held is None else held) >= (self.budget if budget is None else budget)
        return np.where(enough.any(axis=1), BITS - np.argmax(enough[:, ::-1], axis=1), 0)


def _matrix(column, width: int) -> np.ndarray:
    """Binary values to a matrix of doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<f8").reshape(-1, width)


def _packed(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, raw): usable vectors as bytes of doubles, of the length that most have."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    most = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = most["n"] if most else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["vec_id", "raw"])

    kind = rows.schema[vec_id].dataType.simpleString()
    # Rows that repeat id and vector count once; all later passes read the checkpoint.
    return (cut(good.filter(F.size("v") == width).transform(shipped).mapInArrow(run, f"vec_id {kind}, raw binary").dropDuplicates()) if width else None), width


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same whatever rows stand together."""
    return (x * q).sum(axis=1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores and of those as large but for their last digits."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    return at


def fit(packed: DataFrame, width: int, k: int, target: float) -> Forest:
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), width)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([float((x * x).sum(axis=1).max())])], ["n", "m"])

    total = packed.select("raw").transform(shipped).mapInArrow(norms, "n long, m double").agg(F.sum("n").alias("n"), F.max("m").alias("m")).first()
    some = packed.orderBy(F.xxhash64("vec_id"), "vec_id", "raw").limit(SAMPLE).collect()
    sample, ids = np.frombuffer(b"".join(r["raw"] for r in some), dtype="<f8").reshape(-1, width), np.array([r["vec_id"] for r in some])
    forest = Forest(sample, total["n"], float(np.sqrt(total["m"])) * (1 + 1e-12))
    probes, own = sample[:PROBES], ids[:PROBES]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The true neighbours of the probes among a batch: one pass over all rows."""
        for b in batches:
            x, names = _matrix(b.column(1), width), b.column(0).to_numpy(zero_copy_only=False)
            scores = probes @ x.T
            for i in range(len(probes)):
                at = np.flatnonzero(names != own[i])
                at = at[_best(scores[i, at], k)][: 4 * k] if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(scores[i, at]), b.column(1).take(pa.array(at))], ["probe", "score", "raw"])

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "raw")
    near = packed.transform(shipped).mapInArrow(neighbours, "probe long, score double, raw binary").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()
    if near:
        at = np.array([r["probe"] for r in near])
        strings, found = forest.strings(probes, query=True), forest.strings(np.frombuffer(b"".join(r["raw"] for r in near), dtype="<f8").reshape(-1, width))
        differ = strings[at] ^ found
        shared = BITS - np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1))) + 1, 0).min(axis=1)
        held = forest.held(strings)
        for budget in sorted({*held.ravel().tolist()}):
            if (shared >= forest.depths(strings, budget, held)[at]).mean() >= target:
                # Never fewer than 2k rows a tree, so that a handful of rows are all candidates.
                forest.budget = max(budget, 2 * k * TREES)
                break
    return forest


def search(rows: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", target: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `queries` holds, among all others."""
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    packed, width = _packed(rows, vec_id, vector)
    if not width:
        return rows.sparkSession.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    forest = fit(packed, width, k, target)
    depth = forest.depth
    dealt = f"tree int, cell long, string long, depth int, id {kind}, raw binary"
    names = ["tree", "cell", "string", "depth", "id", "raw"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings = forest.strings(_matrix(b.column(1), width))
            for t in range(TREES):
                s = strings[:, t]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), t, dtype=np.int32)), pa.array(s >> (BITS - depth)), pa.array(s), pa.array(np.full(len(s), -1, dtype=np.int32)), b.column(0), b.column(1)], names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query to each cell below its prefix."""
        for b in batches:
            strings = forest.strings(_matrix(b.column(1), width), query=True)
            depths = forest.depths(strings)
            for d in np.unique(depths).tolist():
                rows_ = np.flatnonzero(depths == d)
                wide = 1 << max(0, depth - d)
                for t in range(TREES):
                    s = strings[rows_, t]
                    first = s >> (BITS - min(d, depth)) << max(0, depth - d)
                    for lo in range(0, wide, 64):
                        cells = (first[:, None] + np.arange(lo, min(wide, lo + 64))).ravel()
                        each = len(cells) // max(1, len(rows_))
                        at = pa.array(np.repeat(rows_, each))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), t, dtype=np.int32)), pa.array(cells), pa.array(np.repeat(s, each)), pa.array(np.full(len(cells), d, dtype=np.int32)), b.column(0).take(at), b.column(1).take(at)], names)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = forest.strings(_matrix(b.column(0), width)) >> (BITS - depth)
            for t in range(TREES):
                cell, n = np.unique(at[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, dtype=np.int32)), pa.array(cell), pa.array(n, pa.int64())], ["tree", "cell", "n"])

    crowded = packed.select("raw").transform(shipped).mapInArrow(cells, "tree int, cell long, n long").groupBy("tree", "cell").agg(F.sum("n").alias("n"))
    crowded = crowded.filter(F.col("n") > LIMIT).select("tree", "cell", F.ceil(F.col("n") / LIMIT).cast("int").alias("parts"))
    asked = packed.filter(queries).transform(shipped).mapInArrow(route, dealt).join(crowded, ["tree", "cell"], "left")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    stored = packed.transform(shipped).mapInArrow(index, dealt).join(crowded, ["tree", "cell"], "left")
    stored = stored.withColumn("part", F.pmod(F.xxhash64("id", "raw"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    both = stored.unionByName(asked).repartition("tree", "cell", "part").sortWithinPartitions("tree", "cell", "part", F.when(F.col("depth") < 0, 0).otherwise(1), "string", "depth")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a cell come first and are kept (at most about LIMIT); its queries follow and pass through."""
        key, strings, ids, vectors = None, [], [], []
        ready = None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in (0, 1, 6)], axis=1).astype(np.int64) if len(b) else np.empty((0, 3), dtype=np.int64)
            is_query = b.column(3).to_numpy() >= 0
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1) | (is_query[1:] != is_query[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                if lo == hi:
                    continue
                if key != tuple(keys[lo]):
                    key, strings, ids, vectors, ready = tuple(keys[lo]), [], [], [], None
                part = b.slice(lo, hi - lo)
                s, names_, x = part.column(2).to_numpy(), part.column(4).to_numpy(zero_copy_only=False), _matrix(part.column(5), width)
                if not is_query[lo]:
                    strings.append(s)
                    ids.append(names_)
                    vectors.append(x)
                    continue
                if not ids:
                    continue
                if ready is None:
                    ready = np.concatenate(strings), np.concatenate(ids), np.concatenate(vectors)
                    ready += (k + len(ready[1]) - len(np.unique(ready[1])),)
                yield from found(*ready, s, part.column(3).to_numpy(), names_, x)

    def found(strings, ids, vectors, most, asked_s, asked_d, asked_id, asked_x) -> Iterator[pa.RecordBatch]:
        shift = (BITS - asked_d).astype(np.int64)
        low = asked_s >> shift << shift
        lo, hi = np.searchsorted(strings, low), np.searchsorted(strings, low + (np.int64(1) << shift))
        out: list[tuple] = []
        for a, z in np.unique(np.stack([lo, hi], axis=1), axis=0).tolist():
            if a == z:
                continue
            members = np.flatnonzero((lo == a) & (hi == z))
            for m in range(0, len(members), 256):
                some = members[m : m + 256]
                scores = asked_x[some] @ vectors[a:z].T
                for row, i in zip(scores, some, strict=True):
                    at = np.flatnonzero(ids[a:z] != asked_id[i])
                    at = at[_best(row[at], most)] + a
                    exact = _exact(vectors[at], asked_x[i])
                    order = np.lexsort((ids[at], -exact))[:most]
                    at, exact = at[order], exact[order]
                    out.append((np.full(len(at), asked_id[i]), ids[at], exact))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.select(*names, "part").transform(shipped).mapInArrow(scan, schema).withColumn("rank", F.dense_rank().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()


def query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
