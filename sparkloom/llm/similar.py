"""Links between texts whose sets of word shingles have a similarity (Jaccard) of at least `similarity`, all of them.

SimHash fingerprints within 3 bits find texts with very few changes; at a similarity of 0.8 on five-word shingles
two fingerprints differ by about ten of 64 bits. What holds for fingerprints holds for the sets themselves,
though: sets of a and b shingles with a similarity of s differ in at most (1-s)/(1+s) (a+b) of them. Dealt by
their hashes into more parts than that, they agree in one part whole, so similar texts meet in the bucket of
some part's content and none is missed (the partition scheme of exact set-similarity joins, Deng et al. 2015).
Parts are counted for classes of sizes, each 1/s times the one before; a text is dealt for its own class and for the
next one. A text with enough parts that hold something (nearly all) leaves its empty parts out, which loses nothing.

Similar texts agree in more parts than one, if most hold something: a text with p such parts, of which d may differ, has
p - d in common with each similar one. So it leaves out its p - d - 1 buckets of the most texts (ties by their
signature): of the buckets that two similar texts share, neither leaves out the smallest (the prefix filter of set joins,
on parts). Templates and common passages fill the largest buckets, so this saves most where buckets are hot.

A candidate pair is checked twice: first by eight parity bits for each part (sets differ in no more of them than in
shingles, so this loses nothing either), then, if it passes, by the whole sets. Candidates are

1. the pair, in buckets of two texts;
2. in larger ones, for each text the smallest text that it shares a bucket with; then, in rounds, one member of every
   bucket that still holds different groups, drawn by hash, for the bucket's texts of other groups. A round costs a
   row for each member, and goes on while the last one joined at least one in `JOINED` of the groups;
3. in buckets that hold different groups after that, every pair across groups: a bucket is cut into blocks of a fixed
   number of texts and each two blocks meet in one place, so no task holds a bucket. Texts of one group are never
   compared again, so a group of thousands of near copies costs its links, not its pairs; two texts that share several
   such buckets come out of the first of them only.

Memory: one text's hashes, and two blocks. Buckets are counted by partial aggregation; what is broadcast is counted
first, and joined beyond `BROADCAST` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import cut, shipped

#: Rows of 8 to 40 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1 << 20
#: Texts of a block, and the bytes that the checks of its texts may take.
BLOCK, BLOCK_BYTES = 128, 1 << 22
#: A round of drawn members is followed by another while it joins at least one in so many groups.
JOINED = 8
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP, _EMPTY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """The words of fingerprints: runs of anything but ASCII blanks, ASCII capitals lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text has one."""
    words = words_of(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    width = min(size, len(h))
    total, found = len(h) - width + 1, np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k in range(width):
        found = mixed(found + _STEP + h[k : k + total])
    return np.unique(found)


@cache
def scheme(level: int, similarity: float) -> tuple[int, int]:
    """(largest size, parts) of a class."""
    largest = floor(similarity ** -(level + 1)) + 1
    differ = floor((1 - similarity) / (1 + similarity) * 2 * largest + 1e-9)
    return largest, differ + 5 + differ // 8


def level_of(size: int, similarity: float) -> int:
    return floor(log(size) / -log(similarity))


def _dealt(h: np.ndarray, level: int, similarity: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(parts that hold something, the sums of their hashes, number of parts); parts follow the hashes' order."""
    parts = scheme(level, similarity)[1]
    at = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(at, prepend=np.uint64(parts)))
    return at[starts], np.add.reduceat(mixed(h), starts), parts


def signatures(h: np.ndarray, similarity: float) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The buckets of a set, as signed longs, and for each class (level, buckets, buckets it can do without)."""
    out, classes = [], []
    for level in range(own := level_of(len(h), similarity), own + 2):
        at, sums, parts = _dealt(h, level, similarity)
        largest = scheme(level, similarity)[0]
        kind = np.uint64((level + 1) * int(_EMPTY) % (1 << 64))
        out.append(mixed(sums ^ mixed(at * _STEP + kind)))
        differ = floor((1 - similarity) / (1 + similarity) * (len(h) + min(largest, floor(len(h) / similarity) + 1)) + 1e-9)
        if len(at) <= differ:
            none = np.setdiff1d(np.arange(parts, dtype=np.uint64), at)
            out[-1] = np.append(out[-1], mixed(mixed(none * _STEP + kind) + _EMPTY))
        classes.append((level, len(out[-1]), max(0, len(at) - differ - 1)))
    return np.concatenate(out).view(np.int64), classes


def vector(h: np.ndarray, level: int, similarity: float) -> bytes:
    """Eight bits for each part, flipped by each hash that falls on them: sets that differ in d hashes differ in d bits
    at most, and hardly fewer while the bits are many."""
    bits = scheme(level, similarity)[1] * 8
    at = ((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & np.uint8(1)).tobytes()


def most_apart(a, b, similarity: float):
    """How many shingles similar sets of these sizes may differ in."""
    return np.floor((1 - similarity) / (1 + similarity) * (a + b) + 1e-9)


def held_by(df: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with `keys`, which are broadcast if they are few."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, on, how)


def links(body: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(src, dst) that connect all similar texts. `body`: node (long; one text for each), text."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                found, classes = [], []
                for node, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = shingles(t.as_py(), size)
                    if len(h):
                        sigs, counted = signatures(h, similarity)
                        found.append(sigs)
                        classes += [(node, *c) for c in counted]
                if found:
                    node, level, n, spare = (np.array(c, dtype=np.int64) for c in zip(*classes, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(pa.array(np.repeat(c, n).astype(k)) for c, k in ((node, "i8"), (level, "i1"), (spare, "i4")))], ["sig", "node", "level", "spare"])

    each = body.select("node", "text").transform(shipped).mapInArrow(deal, "sig long, node long, level byte, spare int")
    buckets = each.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    buckets = cut(buckets)
    large = buckets.filter("n > 2").select("sig", "n")
    # Few buckets are shared: their members come from a second pass over the texts, not from a stored list of all parts.
    hottest = Window.partitionBy("node", "level").orderBy(F.desc("n"), "sig")
    kept = held_by(each, large, ["sig"]).withColumn("rank", F.row_number().over(hottest))
    kept = cut(kept.filter("rank > spare").select("sig", "node"))
    again = cut(kept.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("lo")).filter("n > 1"))
    members = cut(held_by(kept, again, ["sig"]))
    pairs = buckets.filter("n = 2").select(F.col("lo").alias("src"), F.col("hi").alias("dst")).distinct()
    first = members.groupBy("node").agg(F.min("lo").alias("lo")).filter("lo < node").select(F.col("lo").alias("src"), F.col("node").alias("dst"))
    pairs = cut(pairs.union(first).distinct())
    wanted = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).union(members.select("node")).distinct()
    facts = _facts(held_by(body.select("node", "text"), cut(wanted), ["node"], "left_semi"), size, similarity)
    found = cut(_verified(pairs, facts, similarity))
    turn, before = 0, None
    while not members.isEmpty():
        told = held_by(members, _told_apart(found), ["node"], "left").select("sig", "node", "n", F.coalesce("grp", "node").alias("grp"))
        drawn = F.min_by(F.struct("node", "grp"), F.xxhash64("node", F.lit(turn))).alias("hub")
        apart = told.groupBy("sig").agg(F.min("grp").alias("a"), F.max("grp").alias("z"), drawn).filter("a < z").select("sig", "hub")
        told = cut(held_by(told, cut(apart), ["sig"]))
        still = told.select("grp").distinct().count()
        if not still:
            break
        last = before is not None and before - still < before / JOINED
        if last:
            pairs = _across(told.drop("hub"), facts, similarity)
        else:
            pairs = told.filter("grp <> hub.grp").select(F.least("node", "hub.node").alias("src"), F.greatest("node", "hub.node").alias("dst"))
        found = cut(found.union(_verified(cut(pairs.distinct()), facts, similarity)))
        if last:
            break
        turn, before = turn + 1, still
    return found


def _told_apart(found: DataFrame) -> DataFrame:
    """(node, grp): texts of one group are known to be connected; not all that are connected need be of one group.

    The smallest neighbour's smallest neighbour: two small joins in place of all connected components."""
    ends = found.union(found.select("dst", "src")).groupBy("src").agg(F.min("dst").alias("least"))
    near = cut(ends.select(F.col("src").alias("node"), F.least("src", "least").alias("grp")))
    far = near.select(F.col("node").alias("grp"), F.col("grp").alias("far"))
    return cut(near.join(far, "grp").select("node", F.col("far").alias("grp")))


def _facts(body: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, size, v0, v1, sh): size of the set, its bits for its class and the next one, the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(1)]
            levels = [level_of(len(h), similarity) for h in sets]
            cols = [[vector(h, v + k, similarity) for h, v in zip(sets, levels, strict=True)] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in (*cols, [h.tobytes() for h in sets]))], ["node", "size", "v0", "v1", "sh"])

    return cut(body.select("node", "text").transform(shipped).mapInArrow(run, "node long, size long, v0 binary, v1 binary, sh binary"))


def _verified(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """The pairs that are similar."""

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i, (m, p0, p1, n, q0, q1) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 8)), strict=True)):
                at = level_of(m, similarity) - level_of(n, similarity)
                if abs(at) <= 1:
                    p, q = (p0, q0) if at == 0 else (p1, q0) if at < 0 else (p0, q1)
                    if np.bitwise_count(np.frombuffer(p, np.uint8) ^ np.frombuffer(q, np.uint8)).sum(dtype=np.int64) <= most_apart(m, n, similarity):
                        good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["src", "dst"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= similarity * (len(p) + len(q) - both):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["src", "dst"])

    def beside(pairs: DataFrame, *names: str) -> DataFrame:
        ends = [facts.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in names]) for end in ("src", "dst")]
        return pairs.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", *[f"{end}_{c}" for end in ("src", "dst") for c in names]).transform(shipped)

    likely = cut(beside(pairs, "size", "v0", "v1").mapInArrow(may, "src long, dst long"))
    return beside(likely, "sh").mapInArrow(same, "src long, dst long")


def _across(told: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different groups in a bucket that may be similar, each once. `told`: sig, node, n, grp.

    Every row brings the smaller ones of its text's buckets (no more than the text has parts): a pair that shares
    one of those comes out there."""
    shared = told.groupBy("node").agg(F.collect_list("sig").alias("sigs"))
    facts = cut(facts.select("node", "size", "v0", "v1").join(shared, "node"))
    room = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.length("v1") + 8 * F.size("sigs"))))).cast("long")
    rows = told.select("sig", "node", "n", "grp").join(facts.select("node", room.alias("room")), "node")
    # All texts of a bucket need one number of blocks, so it follows from the largest of them.
    most = rows.groupBy("sig").agg(F.max(F.ceil(F.col("n") / F.col("room"))).alias("blocks"))
    # Bits and lists join last, so that they are dealt once, to the blocks.
    rows = rows.join(most, "sig").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(facts, "node")
    rows = rows.withColumn("less", F.filter("sigs", lambda x: x < F.col("sig"))).drop("sigs")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["sig", "i", "j"]
    rows = rows.select("sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "grp", "size", "v0", "v1", "less")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, grp, size, mine = (t[c].to_numpy() for c in ("node", "grp", "size", "mine"))
        level = np.array([level_of(x, similarity) for x in size.tolist()])
        v0, v1 = t["v0"].to_pylist(), t["v1"].to_pylist()
        less = [frozenset(x) for x in t["less"].to_pylist()]
        two_blocks = t["i"][0].as_py() != t["j"][0].as_py()
        for top in np.unique(np.append(level, level + 1)).tolist():
            # Pairs whose larger class is `top`; both ends have their bits for it.
            at = np.flatnonzero((level == top) | (level == top - 1))
            if not (level[at] == top).any():
                continue
            table = np.array([np.frombuffer(v0[k] if level[k] == top else v1[k], np.uint8) for k in at.tolist()])
            for x, k in enumerate(at.tolist()):
                y = at[x + 1 :]
                y_ok = (grp[y] != grp[k]) & ((level[y] == top) | (level[k] == top))
                if two_blocks:
                    y_ok &= mine[y] != mine[k]
                if y_ok.any():
                    apart = np.bitwise_count(table[x + 1 :][y_ok] ^ table[x]).sum(axis=1, dtype=np.int64)
                    y = y[y_ok][apart <= most_apart(size[y[y_ok]], size[k], similarity)]
                    y = np.array([j for j in y.tolist() if less[k].isdisjoint(less[j])], dtype=np.int64)
                    if len(y):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[y], node[k])), pa.array(np.maximum(node[y], node[k]))], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not len(t):
                continue
            key = np.stack([t[c].to_numpy() for c in keys], axis=1)
            ends = [*(np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1).tolist()]
            for lo, hi in zip([0, *ends], ends, strict=False):
                yield from compare(t.slice(lo, hi - lo).combine_chunks())
            rest = t.slice(ends[-1] if ends else 0).combine_chunks()
        if rest is not None and len(rest):
            yield from compare(rest)

    return rows.transform(shipped).mapInArrow(run, "src long, dst long").filter("src < dst")
