"""Framework rules, routes and recommendations over the star schema and `pages`.

A page's path with numbers as `[id]` is a page file; a nation's text registers an Express route; a part is a
callable named by its part name with decorators by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import expr, routes
from sparkloom.operators import frameworks, recommend, search
from sparkloom.plans import code_queries as code
from sparkloom.plans.registry import query
from sparkloom.session import table

ROUTE_SQL = r"""p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '\.html$', '') AS path FROM pages),
files AS (SELECT page_id, path, regexp_replace(path, '[0-9]+', '[id]', 'g') AS f FROM p)"""


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1), r"\.html$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(path, "[0-9]+", "[id]").alias("f"))


@query(rf"""WITH {ROUTE_SQL} SELECT page_id, '/' || regexp_replace(regexp_replace(ltrim(f, '/'), '/index$', ''), '\[([^\]]+)\]', ':\1', 'g') AS nuxt, '/' || regexp_replace(ltrim(f, '/'), '\[([^\]]+)\]', ':\1', 'g') AS next_page,
'/api/' || regexp_replace(ltrim(f, '/'), '\[([^\]]+)\]', ':\1', 'g') AS server, rtrim('/' || regexp_replace(ltrim(f, '/'), '\[([^\]]+)\]', ':\1', 'g'), '/') AS next_app, CASE WHEN contains(f, '[id]') THEN 'id' ELSE '' END AS params FROM files""")
def framework_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_routes(spark, sf_dir)
    under = lambda folder, end: F.concat(F.lit(folder), F.ltrim("f", F.lit("/")), F.lit(end))
    nuxt = routes.nuxt_page(under("pages/", ".vue"))
    return rows.select(
        "page_id", nuxt.alias("nuxt"), routes.next_page(under("src/pages/", ".tsx")).alias("next_page"), routes.nuxt_server(under("server/api/", ".ts")).alias("server"),
        routes.next_app(F.concat(F.lit("app/"), F.rtrim(F.ltrim("f", F.lit("/")), F.lit("/")), F.lit("/page.tsx"))).alias("next_app"), F.array_join(F.transform(routes.path_params(nuxt), lambda p: F.regexp_replace(p["name"], "/.*", "")), ",").alias("params"),
    )


NATION_ROUTES = "routes AS (SELECT CAST(n_nationkey AS VARCHAR) AS file, CASE WHEN n_regionkey = 0 THEN 'ALL' WHEN n_regionkey = 1 THEN 'POST' ELSE 'GET' END AS method, '/' || lower(n_name) || '/:id' AS path, 'show' || n_regionkey AS handler FROM nation)"


def nation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = F.when(F.col("n_regionkey") == 0, "all").when(F.col("n_regionkey") == 1, "post").otherwise("get")
    text = F.format_string("const r = express.Router();\napp.use('/r', r);\napp.use(cors());\nrouter.%s('/%s/:id', auth, show%d);\nfunction fail%d(err, req, res, next) { next(err); }", verb, F.lower("n_name"), F.col("n_regionkey"), F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("file"), text.alias("content"))


@query(f"WITH {NATION_ROUTES} SELECT *, 'auth' AS middleware, 'id' AS params FROM routes")
def express_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frameworks.express_routes(nation_sources(spark, sf_dir))
    return got.select("file", "method", "path", "handler", F.array_join("middleware", ",").alias("middleware"), F.array_join("params", ",").alias("params"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, 'cors' AS name, true AS global, false AS error_handler FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'fail' || n_nationkey, false, true FROM nation")
def express_middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameworks.express_middleware(nation_sources(spark, sf_dir))


@query(f"WITH {NATION_ROUTES} SELECT file, method, path FROM routes WHERE method IN ('POST', 'ALL') AND contains(lower(path), 'a')")
def routes_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frameworks.express_routes(nation_sources(spark, sf_dir)).withColumn("methods", F.array("method")).withColumn("framework", F.lit("express"))
    return search.filter_routes(got, "post", "A", "express").select("file", "method", "path")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = code.callables(spark, sf_dir)
    marks = F.array_compact(F.array(F.when(F.col("complexity") > 40, F.lit("@app.task(bind=True)")), F.when(F.col("complexity") < 10, F.lit("@pytest.fixture"))))
    name = F.when(F.col("complexity") == 25, F.concat(F.lit("test_"), "name")).otherwise(F.col("name"))
    return p.withColumn("decorators", marks).withColumn("name", name).withColumn("file", F.concat(F.lit("a/"), F.regexp_replace("file", "#", ""), F.when(F.col("complexity") == 30, "/conftest.py").otherwise("/x.py")))


@query("""WITH f AS (SELECT p_brand || '.' || p_name AS callee, p_size FROM part)
SELECT DISTINCT '__celery__' AS caller, callee FROM f WHERE p_size > 40 UNION SELECT '__pytest__', callee FROM f WHERE p_size < 10 OR p_size = 25
UNION SELECT '__own__', callee FROM f WHERE callee LIKE '%anvil%'""")
def synthetic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameworks.synthetic_edges(decorated(spark, sf_dir), ["celery", "pytest"], [("__own__", [], ["anvil"], [])])


@query("SELECT p_partkey AS seq, CASE WHEN p_size > 25 THEN p_brand || '.' || p_name ELSE p_name END AS callee, CASE WHEN p_name LIKE 'blue%' THEN '/late/' || p_brand WHEN p_name LIKE 'cold%' THEN '/cold' END AS url FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def url_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of each name is a view; two URL patterns for blue ones (the later wins) and one for cold ones."""
    p = table(spark, sf_dir, "part")
    first = p.groupBy("p_name").agg(F.min_by(F.struct("p_partkey", "p_brand", "p_size"), "p_partkey").alias("x")).select(F.col("x.p_partkey").alias("seq"), F.when(F.col("x.p_size") > 25, F.concat("x.p_brand", F.lit("."), "p_name")).otherwise(F.col("p_name")).alias("handler"), "p_name", "x.p_brand")
    n = F.lit(10_000_000)
    blue = first.filter("p_name like 'blue%'")
    patterns = blue.select(F.col("p_name").alias("handler"), F.lit("/early").alias("url"), F.col("seq").alias("seq")).unionByName(blue.select(F.col("p_name").alias("handler"), F.concat(F.lit("/late/"), "p_brand").alias("url"), (F.col("seq") + n).alias("seq")))
    patterns = patterns.unionByName(first.filter("p_name like 'cold%'").select(F.col("p_name").alias("handler"), F.lit("/cold").alias("url"), F.col("seq")))
    return frameworks.link_urls(patterns, first.select("seq", "handler")).select("seq", F.col("handler").alias("callee"), "url")


WORDS = r"""calls AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(text, '[^A-Za-z]+'))) AS call FROM documents),
c AS (SELECT doc_id, call, CASE WHEN regexp_matches(call, '(?i)\b(log|warn|error|info|debug|success|start)\b') THEN 'logging' WHEN regexp_matches(call, '(?i)\b(read|write|exist|mkdir|unlink|stat|readFile|writeFile)\b') THEN 'file-io'
  WHEN regexp_matches(call, '(?i)\b(parse|stringify|encode|decode)\b') THEN 'parsing' WHEN regexp_matches(call, '\b(valid|check|assert|verify|is[A-Z]|has[A-Z])\b') THEN 'validation'
  WHEN regexp_matches(call, '(?i)\b(format|render|generate|template|toString)\b') THEN 'formatting' WHEN regexp_matches(call, '(?i)\b(fetch|request|get|post|put|delete|query|connect)\b') THEN 'data-access'
  WHEN regexp_matches(call, '(?i)\b(config|option|setting|env)\b') THEN 'configuration' ELSE 'core' END AS concern FROM calls WHERE call <> '')"""


@query(f"WITH {WORDS} SELECT CAST(doc_id AS VARCHAR) AS qualified_name, concern, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 2")
def concern_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.array_distinct(F.split("text", "[^A-Za-z]+")), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("qualified_name"), words.alias("calls"))
    return recommend.concern_groups(docs).select("qualified_name", "concern", F.size("calls").cast("long").alias("n"))


RECS = f"""{code.DEAD}, files AS (SELECT file, count(*) AS n, sum(line_count) AS lines FROM dead GROUP BY file), many AS (SELECT * FROM files WHERE n >= 3),
batch AS (SELECT CASE WHEN lines > 100 THEN 'critical' WHEN lines > 40 THEN 'high' ELSE 'medium' END AS priority FROM many),
single AS (SELECT CASE WHEN line_count > 50 THEN 'critical' WHEN line_count > 20 THEN 'high' WHEN line_count > 10 OR exported THEN 'medium' ELSE 'low' END AS priority FROM dead WHERE line_count >= 5 AND file NOT IN (SELECT file FROM many) ORDER BY line_count DESC, seq LIMIT 15),
every AS (SELECT * FROM batch UNION ALL SELECT * FROM single)"""


@query(f"WITH {RECS} SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (priority = '{p}') AS {p}''' for p in recommend.PRIORITIES)} FROM every")
def recommendations_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.summary(recommend.dead_code(code.dead(spark, sf_dir))).drop("estimated_lines_saved")




#: One call for each part, of six forms; the last but one is a builtin at the end of a chain.
CALL_FORMS = """CASE p_size % 6 WHEN 0 THEN 'this.' || a WHEN 1 THEN a || '.' || b WHEN 2 THEN ' ' || b || ' '
  WHEN 3 THEN a || '(1).' || b WHEN 4 THEN a || '.b.map' ELSE 'self.' || a || '.' || b END"""


@query(f"""WITH w AS (SELECT p_partkey, p_size, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b FROM part)
SELECT p_partkey, {CALL_FORMS} AS call,
  CASE p_size % 6 WHEN 0 THEN a WHEN 1 THEN a || '.' || b WHEN 2 THEN b WHEN 3 THEN nullif(a, 'new') WHEN 5 THEN a || '.' || b END AS normal FROM w""")
def call_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    each = table(spark, sf_dir, "part").select("p_partkey", "p_size", words[0].alias("a"), F.element_at(words, -1).alias("b"))
    each = each.select("p_partkey", F.expr(CALL_FORMS).alias("call"))
    return each.select("p_partkey", "call", expr.normalize_call(F.col("call")).alias("normal"))


@query("""WITH n AS (SELECT event_id, CAST(floor(value * value * value * 100) AS BIGINT) AS n FROM events),
k AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1024 * 1024 THEN 1 WHEN n < 1024 * 1024 * 1024 THEN 2 ELSE 3 END AS k FROM n)
SELECT event_id, CASE k WHEN 0 THEN CAST(n AS VARCHAR) || ' B'
  ELSE printf('%.1f', floor(n / pow(1024.0::DOUBLE, k) * 10 + 0.5) / 10) || CASE k WHEN 1 THEN ' KB' WHEN 2 THEN ' MB' ELSE ' GB' END END AS size FROM k""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value as a number of bytes, from a few to gigabytes."""
    size = F.floor(F.col("value") * F.col("value") * F.col("value") * 100)
    return table(spark, sf_dir, "events").select("event_id", expr.human_bytes(size).alias("size"))


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, event_type AS tool, strftime(date_trunc('day', ts) + INTERVAL 1 HOUR * CAST(floor(hour(ts) / 5) * 5 AS BIGINT), '%Y-%m-%d %H:%M:%S') AS bucket FROM events GROUP BY ALL")
def usage_user_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.operators import usage
    from sparkloom.plans.usage_queries import STAMP, usage_events

    got = usage.buckets(usage_events(spark, sf_dir), "session_id", "tool")
    return got.select(F.col("session_id").cast("long").alias("user_id"), "calls", "errors", "tool", F.date_format("bucket", STAMP).alias("bucket"))
