"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon is learned first: words and word beginnings of 3 to 7 letters whose share of toxic documents is
well above the rest, from two fifths of the labelled sample; a few general insults are in it beforehand. The trees learn from the next
two fifths and the calibration from the last. Features of a whole text: lexicon densities at
three strengths, the strongest entries, lexicon words near a second person, capitals, punctuation,
symbols and obfuscated words, lengths. Nothing but the text is an input of a score.

The labelled sample is bounded by `max_train` documents, the first in the order of a hash of their ids, so
everything that reaches the driver is bounded: `max_lexicon` entries and `max_train` rows of 20 numbers.
Scoring is one pass over the documents without a shuffle; memory is bounded by one Arrow batch.

Defined results: a null text scores like an empty one; a document labelled more than once is toxic if any
label says so; null labels are no labels; without both labels in the sample every score is the share of
toxic rows; repeated rows get equal scores; extra columns of the documents are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.boosting import Boosted, isotonic
from sparkloom.session import cut, shipped

WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"(?<=[^\W\d_])[0-9@$*_#!.\-]+(?=[^\W\d_])")
CAPITALS = bytes(range(65, 91))
#: General insults: fixed values known before any label, at the odds of a strong entry.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown jerk imbecile bastard idiota imbécil estúpido estúpida imbécile idiote stupide crétin connard dummkopf trottel arschloch".split())
SECOND = frozenset("you your yours yourself u ur thou du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes ti tus vos".split())
PREFIXES = range(3, 8)
NEAR = 5


def keys_of(word: str) -> list[str]:
    """Lexicon keys of a lower-case word: itself and its beginnings."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Featurizer:
    """Texts to feature rows. The cache of word scores is emptied when full."""

    def __init__(self, lexicon: dict[str, float], cache: int = 300_000):
        self.lexicon, self.limit, self.cache = lexicon, cache, {}

    def score(self, word: str) -> float:
        if len(self.cache) >= self.limit:
            self.cache.clear()
        found = self.lexicon.get
        self.cache[word] = best = max((found(k, 0.0) for k in keys_of(word)), default=0.0)
        return best

    def row(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        n, cache = len(words), self.cache
        found = list(map(cache.get, words))
        if None in found:
            found = [self.score(w) if x is None else x for w, x in zip(words, found, strict=True)]
        scores = np.array(found, dtype=float)
        hits = np.flatnonzero(scores > 1.0)
        strong = scores[hits]
        near = 0
        for i in hits.tolist():
            near += any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1])
        top = np.sort(strong)[::-1][:3].tolist()
        top += [0.0] * (3 - len(top))
        size, m = len(text) or 1, n or 1
        raw = text.encode("utf-8", "replace")
        upper = len(raw) - len(raw.translate(None, CAPITALS))
        bangs, asks = text.count("!"), text.count("?")
        marks = sum(map(text.count, "#*$%&|<>@"))
        return [
            len(hits) / m, float((strong > 2.0).sum()) / m, float((strong > 3.0).sum()) / m,
            float(len(hits)), float((strong > 2.0).sum()), float((strong > 3.0).sum()),
            *top, float(strong.sum()) / m, float(near), near / m,
            upper / size, bangs / m, asks / m, marks / m, len(ODD.findall(text)) / m,
            np.log1p(n), len(text) / m, float(sum(map(SECOND.__contains__, words))) / m,
        ]

    def table(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t or "") for t in texts], dtype=float).reshape(len(texts), 20)


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each lexicon key of the partition: documents that hold it, toxic ones among them."""
    all_, toxic = Counter(), Counter()
    for b in batches:
        for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
            found = {k for w in set(WORD.findall((text or "").lower())) for k in keys_of(w)}
            all_.update(found)
            if y:
                toxic.update(found)
    keys = list(all_)
    for k in range(0, len(keys), 50_000):
        some = keys[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([all_[x] for x in some], pa.int64()), pa.array([toxic[x] for x in some], pa.int64())], ["key", "n", "k"])


class Model:
    """A fitted scorer: lexicon, trees and calibration knots."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(features), *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 8000, max_lexicon: int = 2000, min_docs: int = 6) -> Model:
    """Learn from documents that are not held out. `docs`: doc_id, text. `labels`: doc_id, toxic."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marked = marked.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows of two numbers are broadcast. An id that stands on several rows is learned from one text.
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = cut(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(5))))
    known = sample.filter("half < 2")
    counts = known.select("text", "y").transform(shipped).mapInArrow(_key_counts, "key string, n long, k long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    totals = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")).first()
    bad, good = max(1, totals["k"]), max(1, totals["n"] - totals["k"])
    odds = F.log((F.col("k") + 0.3) / F.lit(bad + 0.6)) - F.log((F.col("n") - F.col("k") + 0.3) / F.lit(good + 0.6))
    entries = counts.filter(F.col("n") >= min_docs).withColumn("odds", odds).filter("odds > 1").orderBy(F.desc(F.col("odds") * F.sqrt("k")), "key").limit(max_lexicon)
    lexicon = dict.fromkeys(INSULTS, 4.0) | {r["key"]: float(r["odds"]) for r in entries.select("key", "odds").collect()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(lexicon)
        for b in batches:
            x = make.table(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["half"], b["y"], pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "half", "y", "x"])

    rows = sample.filter("half >= 2").select("doc_id", "half", F.col("y").cast("int"), "text").transform(shipped).mapInArrow(features, "doc_id long, half long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), 20)
    y, late = np.array([float(r["y"] > 0) for r in rows]), np.array([r["half"] == 4 for r in rows], dtype=bool)
    trees = Boosted().fit(x[~late], y[~late])
    knots = isotonic(trees.raw(x[late]), y[late]) if late.any() else (np.array([0.0]), np.array([y.mean() if len(y) else 0.0]))
    return Model(lexicon, trees, knots)


def score(docs: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """`docs` (text and any more columns) with the column `name` (in place of any of that name)."""
    kept = [c for c in docs.columns if c != name]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(model.lexicon)
        for b in batches:
            found = model.scores(make.table(b.column(kept.index("text")).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*kept, name])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).transform(shipped).mapInArrow(run, f"{fields}, `{name}` double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    s = F.col("toxicity_score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold; same columns as `docs`."""
    name = "_" * (1 + max(map(len, docs.columns)))
    return score(docs, model, name).filter(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
