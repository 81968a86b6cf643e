"""Line dedup: repeated runs of lines found by prefix doubling over line ids; later copies are deleted.

Each non-blank line gets an id that keeps the order of the lines' hashes. Prefix doubling then names every
window of 1, 2, 4, ... lines: the name of a window of 2w lines comes from the names of its two halves, by a
distributed sort of the distinct pairs (`orderBy` and `monotonically_increasing_id`, which keeps the order).
The suffixes that share a name at level k form the interval of the suffix array whose longest common prefix
reaches 2^k lines. Suffixes alone in their interval share no more with any other and leave at once, so each
level works on repeated windows only.

A maximal run is a run of lines of one document that stands at an earlier place too (by document id, then
line) and no longer does with one more line. Runs of `min_words` words or more are deleted. Such a run is the
union of the shortest windows in it that hold `min_words` words, counted forward from a line or backward
from one: any line of the run is in one of them. These windows have at most `min_words` lines, so the
doubling stops there, however long the runs are. A window of n lines is known by the names of the two windows
of the largest power of two in it, at its start and at its end; it is a later copy if its interval holds an
earlier place.

Hot lines: intervals are counted with partial aggregation and joined back with joins that Spark splits
when skewed; no task ever holds all places of a line. Lines are compared by two 64-bit hashes.

Defined results: a null text stays null and has no lines; blank lines stay and are skipped, so lines before
and after one are neighbours; rows that repeat both id and text count as one document and get the same
result; rows with one id and different texts are different documents; a null id sorts first; a table
without rows gives one without rows; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.quality import BLANK_CHARS, words_of
from sparkloom.session import cut

PLACE = ["doc", "th", "at"]


def places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 8) -> DataFrame:
    """One row for each non-blank line: doc, th (hash of the text), at (its number among them), line, h1, h2, and
    ahead and back: the lines of the shortest window of `min_words` words that begins or ends here (null: none)."""
    line = lambda x, i: F.struct(
        i.alias("line"),
        F.xxhash64(x).alias("h1"),
        F.xxhash64(F.lit("second"), x).alias("h2"),
        F.size(words_of(x)).alias("words"),
    )
    body = F.col(f"`{text}`")
    each = docs.select(
        F.col(f"`{doc_id}`").alias("doc"),
        F.xxhash64(body, F.length(body)).alias("th"),
        F.filter(F.transform(F.split(body, "\n"), line), lambda x: x["words"] > 0).alias("lines"),
    )
    each = each.filter(F.size("lines") > 0).dropDuplicates(["doc", "th"])
    words = F.col("lines.words")
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))

    def reach(some: Column) -> Column:
        """How many of the first lines hold min_words words together."""
        more = lambda a, w: F.when(a["words"] >= min_words, a).otherwise(
            F.struct((a["words"] + w).alias("words"), (a["lines"] + 1).alias("lines"))
        )
        return F.aggregate(some, start, more, lambda a: F.when(a["words"] >= min_words, a["lines"]))

    size = F.lit(min_words)
    spans = F.transform(
        "lines",
        lambda x, i: F.struct(
            x.alias("x"),
            reach(F.slice(words, i + 1, size)).alias("ahead"),
            reach(F.reverse(F.slice(words, F.greatest(i + 2 - size, F.lit(1)), F.least(i + 1, size)))).alias("back"),
        ),
    )
    rows = each.select("doc", "th", F.posexplode(spans).alias("at", "s"))
    return rows.select("doc", "th", "at", "s.x.line", "s.x.h1", "s.x.h2", "s.ahead", "s.back")


def _intervals(windows: DataFrame, keys: list[str]) -> DataFrame:
    """What occurs twice or more, with its first place."""
    return windows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter("n > 1").drop("n")


def _named(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that occur twice or more, with `name` in the order of their keys."""
    intervals = _intervals(windows, keys).drop("first").orderBy(*keys).withColumn("name", F.monotonically_increasing_id())
    return windows.join(intervals, keys).drop(*keys)


def repeated_windows(lines: DataFrame, most: int | None = None) -> list[DataFrame]:
    """For each level k the repeated windows of 2^k lines (of at most `most`): doc, th, at, name, ahead of the first
    line and back of the last."""
    levels = []
    found = cut(_named(lines.select(*PLACE, "h1", "h2", "ahead", "back"), ["h1", "h2"]))
    while not found.isEmpty():
        width = 1 << len(levels)
        levels.append(found)
        if most is not None and 2 * width > most:
            break
        order = Window.partitionBy("doc", "th").orderBy("at").rangeBetween(width, width)
        halves = F.max(F.struct("name", "back")).over(order).alias("right")
        pairs = found.select(*PLACE, F.col("name").alias("left"), "ahead", halves).filter("right is not null")
        found = cut(_named(pairs.select(*PLACE, "left", F.col("right.name").alias("right"), "ahead", F.col("right.back").alias("back")), ["left", "right"]))
    return levels


def suffix_array(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The repeated suffixes in order: doc, th, at, levels (the names of their windows of 1, 2, 4, ... lines).

    Sorting by `levels` is the suffix array; suffixes that agree in k names share at least 2^(k-1) lines.
    """
    levels = repeated_windows(places(docs, doc_id, text))
    if not levels:
        return docs.sparkSession.createDataFrame([], "doc long, th long, at int, levels array<bigint>")
    every = levels[0].select(*PLACE, F.lit(0).alias("k"), "name")
    for k, level in enumerate(levels[1:], 1):
        every = every.unionByName(level.select(*PLACE, F.lit(k).alias("k"), "name"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"])
    return every.groupBy(*PLACE).agg(names.alias("levels")).orderBy("levels", *PLACE)


def _shortest(level: DataFrame, k: int) -> DataFrame:
    """The shortest windows of 2^k lines up to twice as many: doc, th, at, size, and their names at both ends."""
    width = 1 << k
    along = Window.partitionBy("doc", "th").orderBy("at")
    near = F.collect_list(F.struct("at", "name"))
    level = level.filter(f"ahead >= {width} or back >= {width}") if k == 0 else level
    rows = level.select(
        *PLACE, "name", "ahead", "back",
        near.over(along.rangeBetween(0, width - 1)).alias("after"),
        near.over(along.rangeBetween(1 - width, 0)).alias("before"),
    )
    last, first = F.col("at") + F.col("ahead") - width, F.col("at") - F.col("back") + width
    named = lambda some, at: F.get(F.filter(some, lambda x: x["at"] == at), F.lit(0))["name"]
    fits = lambda n: (F.col(n) >= width) & (F.col(n) < 2 * width)
    window = lambda at, size, a, z: F.struct(at.cast("int").alias("at"), F.col(size).cast("int").alias("size"), a.alias("a"), z.alias("z"))
    both = F.array_compact(F.array(
        F.when(fits("ahead"), window(F.col("at"), "ahead", F.col("name"), named("after", last))),
        F.when(fits("back"), window(first, "back", named("before", first), F.col("name"))),
    ))
    found = rows.select("doc", "th", F.explode(F.array_distinct(both)).alias("w")).select("doc", "th", "w.*")
    return found.filter("a is not null and z is not null")


def later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 8) -> DataFrame:
    """For each document with later copies: doc, th, dead (the numbers of its lines to delete)."""
    lines = cut(places(docs, doc_id, text, min_words))
    cover = None
    for k, level in enumerate(repeated_windows(lines, min_words)):
        windows = _shortest(level, k)
        keys = ["size", "a", "z"]
        later = windows.join(_intervals(windows, keys), keys).filter(~F.struct(*PLACE).eqNullSafe(F.col("first")))
        # A stage of its own for each join, so that hot windows are split by the engine's skew handling.
        part = cut(later.select("doc", "th", F.col("at").alias("start"), (F.col("at") + F.col("size") - 1).alias("stop")))
        cover = part if cover is None else cover.unionByName(part)
    if cover is None:
        return docs.sparkSession.createDataFrame([], f"doc {docs.schema[doc_id].dataType.simpleString()}, th long, dead array<int>")
    # The reach of the windows that began at or before a line, window by window along the document.
    reach = cover.groupBy("doc", "th", "start").agg(F.max("stop").alias("stop"))
    order = Window.partitionBy("doc", "th").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("th") == F.col("r_th")) & (F.col("at") == F.col("start"))
    reach = reach.withColumnsRenamed({"doc": "r_doc", "th": "r_th"})
    marked = lines.select(*PLACE, "line").join(reach, same, "left").withColumn("reach", F.max("stop").over(order))
    return marked.filter(F.col("reach") >= F.col("at")).groupBy("doc", "th").agg(F.collect_list("line").alias("dead"))


def _judged(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """(row, n_lines, n_removed, clean_text) for each row of `docs`."""
    dead = later_lines(docs, doc_id, text, min_words)
    th = F.xxhash64(F.col(f"`{text}`"), F.length(F.col(f"`{text}`")))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("l_doc"), th.alias("l_th"))
    both = left.join(dead, F.col("l_doc").eqNullSafe(F.col("doc")) & (F.col("l_th") == F.col("th")), "left")
    body = F.col("row").getField(text)
    lines = F.split(body, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dead")), lambda i: F.get(F.col("lines"), i))
    both = both.select("row", "dead", F.when(F.col("dead").isNotNull(), lines).alias("lines"), F.coalesce(F.size(F.filter(lines, lambda x: F.translate(x, BLANK_CHARS, "") != "")), F.lit(0)).alias("n_lines"))
    clean = F.when(F.col("dead").isNull(), body).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("dead").isNull(), 0).otherwise(F.size("dead"))
    return both.select("row", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), clean.alias("clean_text"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 8) -> DataFrame:
    """`docs` with `n_lines`, `n_removed` and `clean_text` (in place of any columns of these names)."""
    added = ("n_lines", "n_removed", "clean_text")
    return _judged(docs, doc_id, text, min_words).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *added)


def query(docs: DataFrame) -> DataFrame:
    """For each document: its non-blank lines, those removed, and digests of what stays."""
    done = dedup(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("clean_text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("clean_text", F.lit(""))).alias("kept_md5"))


def clean(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """The documents without later copies of repeated runs; those with no line left are left out."""
    judged = _judged(docs, "doc_id", "text", min_words).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    columns = {c: F.col("row").getField(c).alias(c) for c in docs.columns}
    columns["text"] = F.col("clean_text").alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return judged.select(*columns.values())


#: The query for DuckDB, from pairs of equal lines: side by side in both places they are runs.
SQL = r"""
WITH kept_rows AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
numbered AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS ln, unnest(range(len(string_split(text, chr(10))))) AS line
  FROM kept_rows
),
lines AS (
  SELECT doc_id, text, ln, line, len(list_filter(regexp_split_to_array(ln, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
         row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS pos
  FROM numbered WHERE regexp_matches(ln, '[^\x20\x09-\x0D]')
),
placed AS (SELECT *, dense_rank() OVER (ORDER BY doc_id, text) AS d FROM lines),
pairs AS (
  SELECT a.d AS ad, b.d AS bd, b.pos - a.pos AS off, b.pos, b.words
  FROM placed a JOIN placed b ON a.ln = b.ln AND (a.d < b.d OR (a.d = b.d AND a.pos < b.pos))
),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY ad, bd, off ORDER BY pos) AS island FROM pairs),
runs AS (
  SELECT bd AS d, min(pos) AS lo, max(pos) AS hi FROM islands GROUP BY ad, bd, off, island HAVING sum(words) >= 8
),
dead AS (
  SELECT DISTINCT p.doc_id, p.text, p.line FROM placed p JOIN (SELECT DISTINCT * FROM runs) r ON r.d = p.d AND p.pos BETWEEN r.lo AND r.hi
),
stay AS (
  SELECT n.doc_id, n.text, string_agg(n.ln, chr(10) ORDER BY n.line) AS clean
  FROM numbered n LEFT JOIN dead USING (doc_id, text, line) WHERE dead.line IS NULL GROUP BY ALL
),
counts AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(d.line) AS n_removed
  FROM lines l LEFT JOIN dead d USING (doc_id, text, line) GROUP BY ALL
)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(coalesce(s.clean, '')) AS BIGINT) AS kept_chars, md5(coalesce(s.clean, '')) AS kept_md5
FROM documents d LEFT JOIN counts c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.text = d.text
LEFT JOIN stay s ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.text = d.text
"""
