"""Quality rules, line first: lines that fail a rule go, then documents that lost too much go.

Everything is a column expression on the document's own row: no shuffle, no Python, and the memory of a
task is bounded by one document. A line (split at "\\n") fails when it is

* navigation: at least three separators (`|`, `»`, `›`, `•`) and one for every four words or more;
* symbol noise (punctuation): at least three characters of `#*$%&|<>` and more than one for five words;
* shouting (punctuation): capitals and no small letters, at least three words and a `!` for every two words;
* boilerplate: a licence, cookie, login or sharing notice of at most thirty words;
* a fragment (punctuation): fewer than three words and no closing punctuation.

Blank lines never fail. The document is rejected when the failing lines hold more than half of its words,
or when it fails the base rules (fewer than 20 words, or over 30 % of them in repeated 8-word windows).

Defined results: a null text counts as empty, an empty text fails the base rules, repeated rows are judged
one by one, an empty table gives an empty table; columns other than the id and the text pass through
untouched in `clean` and are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BARS = "|»›•"
CLOSING = r"[.!?…:;,\"'”’)\]][\x20\x09-\x0D]*$"
NOTICE = (
    r"(?i)\b(all rights reserved|licen[sc]ed under|released under the|copyright|cookies?|privacy policy"
    r"|terms of (use|service)|log ?in|sign (in|up)|subscribe|click here|read more|share this)\b"
)
CAPITAL, SMALL = r"\p{Lu}", r"\p{Ll}"
WINDOW = 8


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def facts(line: Column) -> Column:
    """What the rules ask of a line, each count taken once."""
    return F.struct(
        line.alias("line"),
        F.size(words_of(line)).alias("n"),
        count_chars(line, SYMBOLS).alias("symbols"),
        count_chars(line, BARS).alias("bars"),
        count_chars(line, "!").alias("bangs"),
    )


def line_fails(x: Column, max_notice_words: int = 30) -> Column:
    """The rules for one line, from its `facts`; see the module's text."""
    line, n = x["line"], x["n"]
    shouting = (x["bangs"] >= 2) & (x["bangs"] * 2 >= n) & (n >= 3) & line.rlike(CAPITAL) & ~line.rlike(SMALL)
    return (n > 0) & (
        ((x["bars"] >= 3) & (x["bars"] * 4 >= n))
        | ((x["symbols"] >= 3) & (x["symbols"] * 5 > n))
        | shouting
        | ((n < 3) & ~line.rlike(CLOSING))
        | ((n <= max_notice_words) & line.rlike(NOTICE))
    )


def _windows(hashes: Column, n: Column) -> Column:
    """A hash for each 8-word window, from the words' hashes."""
    return F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _placed(windows: Column) -> Column:
    """(hash, place) of each window in the hashes' order, so that equal windows stand side by side."""
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def measure(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """`docs` with one struct column `quality` (in place of any of that name): the base counts, the cleaned text, the verdict."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # One projection a step: each reads columns that the step before has computed once.
    step = docs.withColumn("__words", words_of(t))
    step = step.withColumn("__n", F.size("__words")).withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    step = step.withColumn("__windows", _windows(F.col("__hashes"), F.col("__n"))).drop("__words", "__hashes")
    step = step.withColumn("__placed", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), _placed(F.col("__windows")))).drop("__windows")
    same = lambda a, b: F.get(F.col("__placed"), a)["h"] == F.get(F.col("__placed"), b)["h"]
    step = step.withColumn("__starts", F.filter("__placed", lambda _, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))).drop("__placed")
    step = step.withColumn(
        "__repeat",
        F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("__starts", lambda p: F.sequence(p["i"], p["i"] + (WINDOW - 1)))))), F.lit(0)),
    ).drop("__starts")
    step = step.withColumn("__repeat", F.greatest("__repeat", F.lit(0)))
    step = step.withColumn("__lines", F.transform(F.split(t, "\n"), facts))
    step = step.withColumn("__good", F.filter("__lines", lambda x: ~line_fails(x)))
    step = step.withColumn("__kept_words", F.aggregate("__good", F.lit(0), lambda s, x: s + x["n"]))
    step = step.withColumn("__clean", F.when(F.size("__good") == F.size("__lines"), t).otherwise(F.array_join(F.transform("__good", lambda x: x["line"]), "\n")))
    step = step.withColumn("__full", F.transform(F.filter("__lines", lambda x: x["n"] > 0), lambda x: x["line"])).drop("__lines", "__good")
    failed = (F.col("__n") < 20) | (F.lit(100) * F.col("__repeat") > F.lit(30) * F.col("__n"))
    lost = F.col("__n") - F.col("__kept_words") > F.lit(max_lost) * F.col("__n")
    found = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.translate(t, BLANK_CHARS, "")).cast("long").alias("word_chars"),
            count_chars(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.col("__repeat").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~lost).alias("kept"),
        F.col("__kept_words").cast("long").alias("kept_words"),
        F.col("__clean").alias("clean_text"),
    )
    # A generator of one row: the optimizer moves no filter on the verdict below it, which would write the steps
    # out again for every reference.
    return step.select(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"], F.explode(F.array(found)).alias("quality"))


def clean(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """The documents that stay, with their failing lines removed; same columns as `docs`."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    judged = measure(held, "text", max_lost)
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    # A null text never stays, so the cleaned text is never null.
    columns[text] = F.col("quality.clean_text")
    if "n_chars" in columns:
        columns["n_chars"] = F.length("quality.clean_text").cast(docs.schema["n_chars"].dataType)
    row = F.struct(*[e.alias(c) for c, e in columns.items()])
    # Not a filter: the optimizer would move it below the steps and write them out again for every reference.
    return judged.select(F.explode(F.when(F.col("quality.kept"), F.array(row))).alias("row")).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    q = measure(docs.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names])


def sql() -> str:
    """The query for DuckDB, from the same patterns; it compares windows and lines themselves, not hashes."""
    words = lambda text: f"list_filter(regexp_split_to_array({text}, '{BLANKS}'), lambda w: w <> '')"
    count = lambda text, chars: f"(length({text}) - length(translate({text}, '{chars}', '')))"
    closing, blank = CLOSING.replace("'", "''"), "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {words('t')} AS ws FROM d),
places AS (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w),
windows AS (SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS g FROM places),
twice AS (SELECT rid, g FROM windows GROUP BY rid, g HAVING count(*) > 1),
covered AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN twice USING (rid, g))),
repeats AS (SELECT rid, count(*) AS n_repeat FROM covered GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
facts AS (
  SELECT rid, line, len({words('line')}) AS n, {count('line', SYMBOLS)} AS symbols, {count('line', BARS)} AS bars, {count('line', '!')} AS bangs FROM lines
),
judged AS (
  SELECT *, n > 0 AND ((bars >= 3 AND bars * 4 >= n) OR (symbols >= 3 AND symbols * 5 > n)
    OR (bangs >= 2 AND bangs * 2 >= n AND n >= 3 AND regexp_matches(line, '{CAPITAL}') AND NOT regexp_matches(line, '{SMALL}'))
    OR (n < 3 AND NOT regexp_matches(line, '{closing}')) OR (n <= 30 AND regexp_matches(line, '{NOTICE}'))) AS fails
  FROM facts
),
by_doc AS (
  SELECT rid, CAST(sum(CASE WHEN fails THEN 0 ELSE n END) AS BIGINT) AS kept_words,
         CAST(count(*) FILTER (n > 0) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS BIGINT) AS n_dup_lines
  FROM judged GROUP BY rid
),
base AS (
  SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(translate(t, {blank}, '')) AS BIGINT) AS word_chars,
         CAST({count('t', SYMBOLS)} AS BIGINT) AS n_symbols, b.n_dup_lines, CAST(coalesce(r.n_repeat, 0) AS BIGINT) AS n_repeat_words, b.kept_words
  FROM d JOIN w USING (rid) JOIN by_doc b USING (rid) LEFT JOIN repeats r USING (rid)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (n_words - kept_words) * 2 <= n_words AS kept
FROM base
"""
