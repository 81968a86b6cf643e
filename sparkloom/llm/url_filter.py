"""URL filter: explicit rules first, then logistic regression on hashed character n-grams of host and path.

Main path: column expressions on the URL alone, one pass without a shuffle. The n-grams (3 and 4 characters
of `^host/path$`, each bucket once) are hashed by a polynomial of their code points, so SQL can compute the
same. The model is fitted on the driver from a small labelled table of at most `max_labelled` URLs by
stochastic gradient descent in a fixed order, and its weights are rounded to whole ten-thousandths: sums
are exact in any order.

Defined results: a null URL or one without `://` has an empty host and path and gets the model's verdict on
them, which is to allow; repeated rows are judged one by one; an empty table gives an empty one; extra
columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16384
FACTORS = (1, 131, 4099, 8191)
SIZES = (3, 4)
SCALE = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (rule, verdict): host and path prefix.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

#: Words in the names of blocked and allowed sites, for the default labelled table.
BLOCKED = "casino poker slots lottery jackpot betting bets pills meds viagra pharmacy adult porn sex xxx cams escorts spam ads adserver popup tracker clickbait loans payday replica warez cracks keygen torrents casinos winning prizes rewards gambling roulette"
ALLOWED = (
    "library university museum history garden kitchen weather theatre station nation education news science physics biology mathematics python recipes cooking travel mountain"
    " rivers forest bicycle music orchestra gallery school college research journal archive parliament council health hospital letters writers stories mother brother"
    " other gathering together thought thirteen nations notion motion therein thence rationale dictionary translation wheat thistle reading building thinking something clothing anything thunder hand thread path month earth"
)
#: Both labels get names of these forms, so that what stands around a word says nothing.
FORMS = ("{}", "{}-online", "best-{}", "free-{}", "my{}")


def default_labelled() -> list[tuple[str, int]]:
    """The default labelled table: (url, 1 to block), with the same kinds of hosts and paths for both labels."""
    table = []
    for label, words in ((1, BLOCKED), (0, ALLOWED)):
        for k, (word, form) in enumerate((w, f) for w in words.split() for f in FORMS):
            front = ("", "www.", "blog.", "m.")[k % 4]
            lang = ("en", "de", "fr", "es")[k // 4 % 4]
            table.append((f"https://{front}{form.format(word)}.example.{('com', 'net', 'org')[k % 3]}/{lang}/{(k * 37) % 1000}{('', '/', '.html')[k // 2 % 3]}", label))
    return table


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, PARTS, 1), UPPER, LOWER), F.regexp_extract(u, PARTS, 2)


def buckets(host: Column, path: Column) -> Column:
    """The distinct buckets of a URL's n-grams."""
    text = F.concat(F.lit("^"), host, F.lit("/"), path, F.lit("$"))
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))

    def grams(size: int) -> Column:
        places = F.when(F.size(codes) >= size, F.sequence(F.lit(0), F.size(codes) - size)).otherwise(F.array().cast("array<int>"))
        hashed = lambda i: sum((F.get(codes, i + k) * FACTORS[k] for k in range(size)), F.lit(size * 17).cast("long")) % BUCKETS
        return F.transform(places, lambda i: hashed(i).cast("int"))

    return F.array_distinct(F.concat(*[grams(n) for n in SIZES]))


def buckets_of(host: str, path: str) -> set[int]:
    """The same for the labelled table, on the driver."""
    codes = [ord(c) for c in f"^{host}/{path}$"]
    return {(sum(c * f for c, f in zip(codes[i : i + n], FACTORS, strict=False)) + n * 17) % BUCKETS for n in SIZES for i in range(len(codes) - n + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    stop = min((rest.find(c, end) for c in "?#" if rest.find(c, end) >= 0), default=len(rest))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), rest[end:stop]


def fit(labelled: list[tuple[str, int]] | DataFrame | None = None, max_labelled: int = 2000, rounds: int = 40, rate: float = 0.3, decay: float = 1e-3) -> tuple[int, list[int]]:
    """(bias, weights) in ten-thousandths, from (url, 1 to block) rows."""
    if isinstance(labelled, DataFrame):
        labelled = [(r[0], r[1]) for r in labelled.dropna().distinct().orderBy(*labelled.columns).limit(max_labelled).collect()]
    rows = [(sorted(buckets_of(*split_url(u))), y) for u, y in (default_labelled() if labelled is None else labelled[:max_labelled])]
    rows = [rows[k * 7919 % len(rows)] for k in range(len(rows))] if len(rows) % 7919 else rows
    bias, weights = 0.0, [0.0] * BUCKETS
    for turn in range(rounds):
        step = rate / (1 + turn / 10)
        for found, y in rows:
            z = bias + sum(weights[i] for i in found) / math.sqrt(len(found) or 1)
            miss = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += step * miss * 0.1
            for i in found:
                weights[i] += step * (miss / math.sqrt(len(found)) - decay * weights[i])
    return round(bias * SCALE), [round(w * SCALE) for w in weights]


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{prefix}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] | None = None, model: tuple[int, list[int]] | None = None) -> DataFrame:
    """`pages` with host, path, rule, verdict and logit (of the model, whatever the rule says)."""
    bias, weights = model or fit()
    host, path = host_and_path(F.col(f"`{url}`"))
    named = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    table = F.from_json(F.lit(str(weights)), "array<bigint>")
    step = named.withColumn("buckets", buckets(F.col("host"), F.col("path"))).withColumn("fit", rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, i: s + F.get(table, i))
    step = step.withColumn("total", total)
    logit = F.lit(bias / SCALE) + F.col("total") / F.lit(float(SCALE)) / F.sqrt(F.greatest(F.size("buckets"), F.lit(1)).cast("double"))
    guess = F.when(logit > 0, "block").otherwise("allow")
    return step.select("row.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", guess).alias("verdict"), logit.alias("logit"))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def sql() -> str:
    """The query for DuckDB, with the fitted weights written out."""
    bias, weights = fit()
    gram = lambda n: f"list_transform(range(1, length(t) - {n} + 2), lambda i: ({' + '.join(f'unicode(t[i + {k}]) * {FACTORS[k]}' for k in range(n))} + {n * 17}) % {BUCKETS})"
    cases = " ".join(
        f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{prefix}') THEN '{rule}'"
        for rule, (at, _, prefix) in ((r, r.partition("/")) for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])))
    )
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in RULES)
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages
), texts AS (SELECT *, concat('^', host, '/', path, '$') AS t FROM parts),
grams AS (SELECT *, list_distinct(list_concat({gram(3)}, {gram(4)})) AS g FROM texts),
weights AS (SELECT {weights} AS w),
scored AS (SELECT page_id, host, path, CASE {cases} END AS rule, {bias} / {SCALE}.0 + list_sum(list_transform(g, lambda i: w[i + 1]))::DOUBLE / {SCALE}.0 / sqrt(greatest(len(g), 1)) AS logit FROM grams, weights)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, CASE WHEN logit > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM scored
"""
