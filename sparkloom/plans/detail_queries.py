"""Queries of the smaller operators: types, calls of copies, files of nodes, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import expr
from sparkloom.operators import graph, quality, search
from sparkloom.plans import code_queries as code
from sparkloom.plans.registry import query
from sparkloom.session import table

#: A written type for each part: short ones, long ones with notes, and long ones without.
TYPES = """CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN 'Annotated[' || p_type || ', Doc("' || repeat(p_name || ' ', 12) || '")]'
  WHEN 2 THEN repeat(p_type || '  |  ', 12) ELSE 'Optional[' || p_type || ', Doc( "' || repeat(p_brand, 20) || '" )]' END"""


@query(f"""WITH t AS (SELECT p_partkey, {TYPES} AS w FROM part),
a AS (SELECT *, regexp_replace(w, ',?\\s*Doc\\(\\s*"[^"]*"\\s*\\)', '', 'g') AS x FROM t),
b AS (SELECT *, trim(regexp_replace(regexp_replace(x, 'Annotated\\[([^,\\]]+),\\s*[^\\]]+\\]', '\\1', 'g'), '\\s+', ' ', 'g')) AS y FROM a)
SELECT p_partkey, CASE WHEN length(w) <= 120 THEN w WHEN length(y) > 120 THEN y[1:117] || '...' ELSE y END AS type FROM b""")
def truncated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", expr.truncate_type(F.expr(TYPES)).alias("type"))


@query("""SELECT event_id, CAST(strlen('{"type":"' || event_type || '","user":' || user_id || '}') AS INTEGER) AS bytes FROM events""")
def event_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", expr.json_bytes(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("bytes"))


@query(f"""WITH {code.CALLS}, e AS (SELECT DISTINCT name AS base, file, qualified_name AS name, seq, unnest(calls) AS call FROM full_),
n AS (SELECT name AS base, count(*) AS copies FROM full_ GROUP BY 1), h AS (SELECT base, call, count(*) AS k FROM e GROUP BY 1, 2)
SELECT e.base, e.file, e.name, e.call, k = copies AS shared FROM e JOIN n USING (base) JOIN h USING (base, call)""")
def duplicate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code.with_calls(spark, sf_dir)
    return quality.copy_calls(rows.select(F.col("name").alias("base"), "file", F.col("qualified_name").alias("name"), "calls"))


@query("""SELECT p_brand || '.' || p_name AS node, CASE WHEN count(*) FILTER (p_size > 25) > 0 THEN min(p_type) FILTER (p_size > 25) ELSE min(p_brand) END AS file
FROM part GROUP BY 1, p_brand""")
def node_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the parts are functions of their type's file; the others are members of their brand's class."""
    p = table(spark, sf_dir, "part").withColumn("node", F.concat("p_brand", F.lit("."), "p_name"))
    functions = p.filter("p_size > 25").select(F.col("node").alias("name"), F.col("p_type").alias("file"))
    classes = p.select(F.col("p_brand").alias("name"), F.col("p_brand").alias("file"))
    return graph.node_files(p.select("node").distinct(), functions, classes)


@query("SELECT p_partkey AS seq, p_name AS name FROM part WHERE p_brand = 'Brand#11' AND split_part(p_type, ' ', 1) = 'STANDARD' AND contains(lower(p_name), 'e')")
def models_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    models = p.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_brand").alias("framework"), F.split("p_type", " ")[0].alias("kind"))
    return search.filter_models(models, "Brand#11", "STANDARD", "E").select("seq", "name")


@query("""WITH d AS (SELECT p_name AS package, p_size AS version, p_brand AS type FROM part)
SELECT type, count(*) AS n, array_to_string(list_sort(list_distinct(list(package || '@' || version))), ', ') AS packages FROM d GROUP BY 1""")
def dependencies_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return search.dependencies_by_type(p.select(F.col("p_name").alias("package"), F.col("p_size").cast("string").alias("version"), F.col("p_brand").alias("type")))


@query("""WITH c AS (SELECT user_id || '.' || event_type AS call FROM events)
SELECT call, count(*) AS n FROM (SELECT CASE WHEN call LIKE '%.view' THEN 'map.get' WHEN call LIKE '%.click' THEN 'list.push' ELSE call END AS call FROM c)
WHERE call NOT IN ('map.get', 'list.push') GROUP BY 1""")
def telling_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.concat(F.col("user_id").cast("string"), F.lit("."), "event_type")
    call = F.when(F.col("event_type") == "view", "map.get").when(F.col("event_type") == "click", "list.push").otherwise(call)
    each = table(spark, sf_dir, "events").select(F.explode(expr.telling_calls(F.array(call))).alias("call"))
    return each.groupBy("call").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT p_brand AS module, round(avg(CAST(p_size AS DOUBLE)), 6) AS instability FROM part GROUP BY 1)
SELECT * FROM m ORDER BY instability DESC, module LIMIT 10""")
def unstable_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("module")).agg(F.round(F.avg(F.col("p_size").cast("double")), 6).alias("instability"))
    return search.modules_in_scope(modules)
