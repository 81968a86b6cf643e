"""Callables, entities and files over the star schema and `pages`.

A part is a method of its brand's class: complexity its size, lines twice that and five, nesting the tenth of its
size, return type the first word of its type, parameters its type and size, calls the customers who ordered it.
Entities are parts, suppliers, customers and nations by name. A page is a file: host and path of its URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import expr
from sparkloom.operators import quality, search
from sparkloom.plans.registry import query
from sparkloom.session import table


def callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_brand").alias("class_name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), F.lit("method").alias("kind"),
        F.lit(1).alias("param_count"), F.concat("p_type", F.lit(":"), F.col("p_size").cast("string")).alias("param_signature"), F.element_at(F.split("p_type", " "), 1).alias("return_type"),
        F.when(F.col("p_retailprice") > 950, "public").otherwise("private").alias("access"), (F.col("p_retailprice") > 950).alias("exported"),
        F.col("p_size").alias("complexity"), (F.col("p_size") * 2 + 5).alias("line_count"), F.floor(F.col("p_size") / 10).cast("int").alias("nesting_depth"), F.col("p_partkey").alias("seq"),
    )


def with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("seq"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    # Dealt before grouping, as numbers: sets of one call would only make the rows of the shuffle longer.
    made = line.join(orders, "l_orderkey").select("seq", "o_custkey").repartition("seq").groupBy("seq").agg(F.collect_set("o_custkey").alias("made"))
    calls = made.select("seq", F.transform("made", lambda c: F.concat(F.lit("C"), c.cast("string"))).alias("calls"))
    return callables(spark, sf_dir).join(calls, "seq", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))


CALLABLES = """f AS (
  SELECT p_partkey AS seq, p_brand AS file, p_name AS name, p_brand AS class_name, p_brand || '.' || p_name AS qualified_name, p_type || ':' || p_size AS signature, split_part(p_type, ' ', 1) AS return_type,
         p_retailprice > 950 AS exported, CAST(p_size AS BIGINT) AS complexity, CAST(p_size * 2 + 5 AS BIGINT) AS line_count, CAST(floor(p_size / 10) AS BIGINT) AS nesting FROM part)"""
#: Calls: each supplier calls the part of its dearest sale, line number by line number.
DEAREST = """dearest AS (SELECT l_partkey FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey DESC, l_orderkey DESC) = 1)"""
REVERSE = f"{DEAREST}, rev AS (SELECT DISTINCT p_brand || '.' || p_name AS callee FROM part JOIN dearest ON l_partkey = p_partkey)"
ENTRIES = "entry AS (SELECT DISTINCT p_brand AS file FROM part WHERE p_brand LIKE 'Brand#1%')"
SHARED = "shared AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size = 50)"
DEAD = f"""{CALLABLES}, {REVERSE}, {ENTRIES}, {SHARED},
dead AS (SELECT f.*, CASE WHEN exported THEN 'low' ELSE 'high' END AS confidence FROM f WHERE file NOT IN (SELECT file FROM entry) AND qualified_name NOT IN (SELECT callee FROM rev))"""


def dearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, caller): the calls behind the reverse edges."""
    best = F.max(F.struct("l_extendedprice", "l_partkey", "l_orderkey")).alias("x")
    sales = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(best)
    return sales.select(F.col("x.l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("caller"))


def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    line = dearest(spark, sf_dir)
    reverse = p.join(line, "p_partkey").select(F.concat("p_brand", F.lit("."), "p_name").alias("callee"), "caller")
    entries = p.filter("p_brand like 'Brand#1%'").select(F.col("p_brand").alias("file"))
    return quality.dead_functions(callables(spark, sf_dir), reverse, entries, p.filter("p_size = 50").select(F.col("p_name").alias("name")))


@query(f"WITH {DEAD} SELECT seq, qualified_name, file, line_count, exported AS is_exported, confidence FROM dead")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead(spark, sf_dir).select("seq", "qualified_name", "file", F.col("line_count").cast("long").alias("line_count"), "is_exported", "confidence")


@query(f"""WITH {DEAD}, c AS (SELECT (SELECT count(*) FROM f) AS total, count(*) AS dead, CAST(coalesce(sum(line_count), 0) AS BIGINT) AS dead_lines, count(*) FILTER (confidence = 'high') AS high_confidence FROM dead)
SELECT *, floor(dead::DOUBLE / total * 100 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS percentage FROM c""")
def dead_code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dead_summary(callables(spark, sf_dir), dead(spark, sf_dir))


@query(f"WITH {CALLABLES}, {REVERSE} SELECT seq, qualified_name, line_count FROM f WHERE exported AND qualified_name NOT IN (SELECT callee FROM rev) ORDER BY line_count DESC, seq LIMIT 30")
def dead_exported_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, line = table(spark, sf_dir, "part"), dearest(spark, sf_dir)
    reverse = p.join(line, "p_partkey").select(F.concat("p_brand", F.lit("."), "p_name").alias("callee"))
    functions = callables(spark, sf_dir).withColumn("kind", F.lit("function"))
    return quality.dead_exported(functions, reverse).select("seq", "qualified_name", F.col("line_count").cast("long").alias("line_count"))


HOT = f"""{CALLABLES}, gods AS (SELECT class_name, file, count(*) AS methods, min(seq) AS seq FROM f GROUP BY 1, 2 HAVING count(*) > 10),
hot AS (
  SELECT 'high_complexity' AS type, qualified_name AS target, file, 'complexity' AS metric, complexity AS value, 10 AS threshold, CASE WHEN complexity > 20 THEN 'critical' ELSE 'warning' END AS severity, seq FROM f WHERE complexity > 10
  UNION ALL SELECT 'god_class', class_name, file, 'method_count', methods, 10, CASE WHEN methods > 20 THEN 'critical' ELSE 'warning' END, seq FROM gods)"""


@query(f"WITH {HOT} SELECT * EXCLUDE (seq) FROM (SELECT * FROM hot ORDER BY severity, value DESC, hot.seq, hot.type LIMIT 20)")
def hotspots_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.hotspots(callables(spark, sf_dir)).drop("seq")


@query(f"WITH {CALLABLES} SELECT file, class_name, count(*) AS methods, count(*) > 10 AS god FROM f GROUP BY 1, 2")
def god_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.class_metrics(callables(spark, sf_dir)).drop("seq")


HEALTH = f"""{DEAD}, m AS (
  SELECT count(*) AS total_functions, CAST(sum(complexity) AS BIGINT) AS total_complexity, count(*) FILTER (complexity > 10) AS over_complexity, count(*) FILTER (line_count > 50) AS over_lines,
         first(qualified_name ORDER BY complexity DESC, seq) AS max_function, max(complexity) AS max_complexity, count(DISTINCT file) AS total_classes FROM f),
g AS (SELECT count(*) AS god_classes FROM (SELECT file FROM f GROUP BY file HAVING count(*) > 10)),
d AS (SELECT count(*) AS dead, count(*) FILTER (confidence = 'high') AS high_confidence FROM dead),
h AS (SELECT *, floor(dead::DOUBLE / total_functions * 100 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS percentage, floor(total_complexity::DOUBLE / total_functions * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS avg_complexity,
  CAST(greatest(0, floor(100.0::DOUBLE - (least(25.0::DOUBLE, over_complexity::DOUBLE / total_functions * 100 * 0.8::DOUBLE) + least(20.0::DOUBLE, over_lines::DOUBLE / total_functions * 100 * 0.5::DOUBLE)
  + least(15.0::DOUBLE, god_classes::DOUBLE / total_classes * 100 * 0.5::DOUBLE) + least(10.0::DOUBLE, high_confidence::DOUBLE / total_functions * 100 * 0.5::DOUBLE)) + 0.5::DOUBLE)) AS BIGINT) AS score FROM m, g, d)"""


def health_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = callables(spark, sf_dir)
    return quality.health(c, c.select("class_name").distinct(), dead(spark, sf_dir))


@query(f"WITH {HEALTH} SELECT * FROM h")
def health_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_row(spark, sf_dir)


@query(f"WITH {HEALTH} SELECT score >= 70 AS passed, CASE WHEN score < 70 THEN 'score below threshold' ELSE 'ok' END AS reason FROM h")
def health_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate(health_row(spark, sf_dir))


CALLS = f"""{CALLABLES}, called AS (SELECT l_partkey AS seq, list_sort(list_distinct(list('C' || o_custkey))) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
full_ AS (SELECT f.*, coalesce(c, []) AS calls FROM f LEFT JOIN called USING (seq))"""


@query(f"""WITH {CALLS}, g AS (SELECT name AS base, count(*) AS members, count(DISTINCT file) AS files FROM full_ GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT file) > 1),
pairs AS (SELECT a.name AS base, CASE WHEN len(a.calls) = 0 AND len(b.calls) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.calls, b.calls))::DOUBLE / len(list_distinct(list_concat(a.calls, b.calls))) END AS s, a.signature = b.signature AS same
  FROM full_ a JOIN full_ b ON a.name = b.name AND a.seq < b.seq),
best AS (SELECT base, max(s) AS max_similarity, bool_or(same) AS same_signature FROM pairs GROUP BY 1)
SELECT base, members, files, max_similarity, same_signature FROM g JOIN best USING (base) WHERE max_similarity > 0.3 OR same_signature""")
def dup_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.same_name_groups(with_calls(spark, sf_dir))


@query(f"""WITH {CALLS}, pairs AS (
  SELECT a.qualified_name AS name_a, a.file AS file_a, b.qualified_name AS name_b, b.file AS file_b,
    CASE WHEN len(a.calls) = 0 AND len(b.calls) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.calls, b.calls))::DOUBLE / len(list_distinct(list_concat(a.calls, b.calls))) END * 0.35::DOUBLE
    + CASE WHEN a.signature = b.signature THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * 0.25::DOUBLE + CASE WHEN a.return_type = b.return_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.10::DOUBLE
    + ((least(a.complexity, b.complexity) + 1)::DOUBLE / (greatest(a.complexity, b.complexity) + 1) + (least(a.line_count, b.line_count) + 1)::DOUBLE / (greatest(a.line_count, b.line_count) + 1)
      + (least(a.nesting, b.nesting) + 1)::DOUBLE / (greatest(a.nesting, b.nesting) + 1)) / 3 * 0.15::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE AS s
  FROM full_ a JOIN full_ b ON a.seq < b.seq AND a.file <> b.file AND a.name <> b.name AND greatest(a.line_count, b.line_count) <= 2 * least(a.line_count, b.line_count))
SELECT name_a, file_a, name_b, file_b, floor(s * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS similarity FROM pairs WHERE s >= 0.6""")
def dup_cross_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cross_name_pairs(with_calls(spark, sf_dir), least=0.6)


# --- entities by name ------------------------------------------------------------------------------------


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, name, file, exported, callers, seq): parts as methods, suppliers as classes, customers as functions, nations as types."""
    part, supplier, customer, nation = (table(spark, sf_dir, n) for n in ("part", "supplier", "customer", "nation"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("callers"))
    none = F.lit(0).cast("long")
    rows = [
        part.select(F.lit("method").alias("kind"), F.concat("p_brand", F.lit("."), "p_name").alias("name"), F.col("p_brand").alias("file"), (F.col("p_size") > 25).alias("exported"), none.alias("callers"), F.concat(F.lit("1-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("seq")),
        supplier.select(F.lit("class"), "s_name", F.lit("supplier.test.ts"), F.col("s_acctbal") > 0, none, F.concat(F.lit("2-"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"))),
        customer.join(orders, "c_custkey", "left").select(F.lit("function"), "c_name", F.col("c_mktsegment"), F.col("c_acctbal") > 0, F.coalesce("callers", F.lit(0)), F.concat(F.lit("3-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))),
        nation.select(F.lit("type"), "n_name", F.lit("nation"), F.lit(True), none, F.concat(F.lit("4-"), F.lpad(F.col("n_nationkey").cast("string"), 12, "0"))),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


ENTITIES = """e AS (
  SELECT 'method' AS kind, p_brand || '.' || p_name AS name, p_brand AS file, p_size > 25 AS exported, CAST(0 AS BIGINT) AS callers, '1-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS seq FROM part
  UNION ALL SELECT 'class', s_name, 'supplier.test.ts', s_acctbal > 0, 0, '2-' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') FROM supplier
  UNION ALL SELECT 'function', c_name, c_mktsegment, c_acctbal > 0, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey), '3-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') FROM customer
  UNION ALL SELECT 'type', n_name, 'nation', true, 0, '4-' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0') FROM nation),
tok AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[._\\-/]', ' ', 'g')), '\\s+'), lambda t: length(t) > 1) AS tokens FROM e)"""


def _ranked(query_tokens: str, term: str) -> str:
    hit = "CASE WHEN list_contains(tokens, q) THEN 2.0::DOUBLE WHEN len(list_filter(tokens, lambda n: starts_with(n, q) OR starts_with(q, n))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""hits AS (SELECT *, CASE WHEN len(tokens) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform({query_tokens}, lambda q: {hit})) / len({query_tokens}) END AS ts FROM tok),
based AS (SELECT *, CASE WHEN ts > 0 THEN ts WHEN contains(lower(name), '{term}') THEN 0.5::DOUBLE END AS base FROM hits),
ranked AS (SELECT kind, name, base * 10 + CASE WHEN exported THEN 3 ELSE 0 END + least(callers, 5) + CASE WHEN kind = 'class' THEN 1 ELSE 0 END - CASE WHEN starts_with(name, '_') THEN 3 ELSE 0 END
  - CASE WHEN contains(file, '.test.') OR contains(file, '.spec.') OR contains(file, '__tests__') THEN 5 ELSE 0 END AS score, seq FROM based WHERE base IS NOT NULL)"""


@query(f"WITH {ENTITIES} SELECT seq, array_to_string(tokens, ' ') AS tokens FROM tok")
def tokenize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("seq", F.array_join(expr.tokenize(F.col("name")), " ").alias("tokens"))


@query(f"WITH {ENTITIES}, {_ranked(chr(91) + repr('supplier') + ', ' + repr('bra') + chr(93), 'supplier bra')} SELECT seq, ts AS score FROM hits")
def token_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(F.lit("supplier"), F.lit("bra"))
    return entities(spark, sf_dir).select("seq", expr.token_score(q, expr.tokenize(F.col("name"))).alias("score"))


@query(f"WITH {ENTITIES}, {_ranked(chr(91) + repr('supplier') + ', ' + repr('customer') + chr(93), 'supplier customer')} SELECT kind, name, score::DOUBLE AS score, seq FROM ranked ORDER BY score DESC, seq LIMIT 30")
def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(entities(spark, sf_dir), "SupplierCustomer").select("kind", "name", "score", "seq")


@query(f"WITH {ENTITIES}, {_ranked(chr(91) + repr('omer') + chr(93), 'omer')} SELECT kind, name, score::DOUBLE AS score, seq FROM ranked")
def substring_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(entities(spark, sf_dir), "omer", None).select("kind", "name", "score", "seq")


@query(f"WITH {ENTITIES} SELECT kind, name, seq FROM e WHERE contains(lower(CASE WHEN kind = 'method' THEN list_last(string_split(name, '.')) ELSE name END), 'an')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring(entities(spark, sf_dir), "AN").select("kind", "name", "seq")


@query(f"WITH {ENTITIES}, n AS (SELECT p_name AS w FROM part ORDER BY p_partkey LIMIT 1) SELECT kind, name, seq FROM e WHERE kind IN ('function', 'method') AND (name = (SELECT w FROM n) OR ends_with(name, '.' || (SELECT w FROM n))) ORDER BY seq LIMIT 1")
def function_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "part").orderBy("p_partkey").first()["p_name"]
    return search.by_name(entities(spark, sf_dir), name).select("kind", "name", "seq")


@query(f"WITH {ENTITIES} SELECT kind, name, seq FROM e WHERE kind = 'type' AND name = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def type_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "nation").filter("n_nationkey = 3").first()["n_name"]
    return search.by_name(entities(spark, sf_dir), name, ("type",)).select("kind", "name", "seq")


@query(f"WITH {ENTITIES} SELECT kind, name, seq, 0.0::DOUBLE AS score FROM e WHERE kind = 'class' AND name = (SELECT s_name FROM supplier WHERE s_suppkey = 4)")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "supplier").filter("s_suppkey = 4").first()["s_name"]
    return search.lookup(entities(spark, sf_dir), name).select("kind", "name", "seq", "score")


@query(f"WITH {ENTITIES} SELECT file AS module, count(*) FILTER (kind = 'method') AS functions, count(DISTINCT seq) AS files, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'type') AS types FROM e GROUP BY file")
def module_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).withColumn("module", F.col("file"))
    kind = lambda k: e.filter(F.col("kind") == k)
    return search.module_stats(e, kind("method"), kind("class"), kind("type"))


@query(f"WITH {ENTITIES} SELECT kind, count(*) AS n, count(*) FILTER (exported) AS exported FROM e GROUP BY kind")
def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("exported").alias("exported"))


# --- files -----------------------------------------------------------------------------------------------


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return p.select("page_id", "url", "html", path.alias("path"), expr.module_of(path).alias("module"), expr.content_hash(F.col("html")).alias("hash"))


PAGES = r"""p AS (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path, substr(md5(html), 1, 8) AS hash FROM pages),
files AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS module FROM p)"""


@query(f"WITH {PAGES} SELECT page_id, path, module, replace(module, '/', '__') AS key, hash FROM files")
def url_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(spark, sf_dir).select("page_id", "path", "module", expr.module_key(F.col("module")).alias("key"), "hash")


@query(f"WITH {PAGES} SELECT page_id, path FROM files WHERE module LIKE '%.example.org/en' OR module LIKE '%.example.org/en/%'")
def module_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = page_files(spark, sf_dir).withColumn("module", F.regexp_replace("module", r"^.*\.example", "example"))
    return search.in_module(f, "example.org/en").select("page_id", "path")


@query(f"WITH {PAGES} SELECT page_id, path FROM files WHERE contains(path, '/fr/1')")
def files_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_path(page_files(spark, sf_dir), "/fr/1").select("page_id", "path")


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))), ' ') AS links, regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS script,
array_to_string(list_sort(list_distinct(regexp_extract_all(html, '</?([a-z][a-z0-9-]*)', 1))), ' ') AS tags FROM pages""")
def page_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, the first script block and the tags in use, each once."""
    every = lambda p: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(p), 1))), " ")
    return table(spark, sf_dir, "pages").select("page_id", every('href="([^"]+)"').alias("links"), F.regexp_extract("html", r"(?s)<script[^>]*>(.*?)</script>", 1).alias("script"), every("</?([a-z][a-z0-9-]*)").alias("tags"))


@query(f"""WITH {PAGES}, old AS (SELECT path || '#' || page_id AS path, hash FROM files WHERE starts_with(url, 'https:')), new AS (SELECT path || '#' || page_id AS path, substr(md5(lower(html)), 1, 8) AS hash FROM files WHERE length(html) > 1500)
SELECT path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old o FULL JOIN new n USING (path) WHERE o.hash IS NULL OR n.hash IS NULL OR o.hash <> n.hash""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secure pages as they are, against the longer pages in lower case."""
    f = page_files(spark, sf_dir).withColumn("path", F.concat("path", F.lit("#"), "page_id"))
    return search.snapshot_diff(f.filter("startswith(url, 'https:')").select("path", "hash"), f.filter(F.length("html") > 1500).select("path", expr.content_hash(F.lower("html")).alias("hash")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, strftime(o_orderdate, '%Y-%m-%d') AS changed FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01'")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    return search.stale(files, "1997-06-01").select("path", F.date_format("mtime", "yyyy-MM-dd").alias("changed"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS word FROM documents)
SELECT word, count(*) AS docs FROM w WHERE word <> '' GROUP BY word""")
def term_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each name stands: names to distinct files, as for environment variables."""
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("word")).filter("word <> ''")
    return each.groupBy("word").agg(F.count("*").alias("docs"))
