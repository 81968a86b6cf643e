"""Graph operators over the star schema.

Dependency edges: a supplier k depends on (7k+3) mod N if its balance is positive and on (13k+5) mod N if it is
under 3000, N being the number of suppliers; its module is its nation. Call edges: a supplier calls the parts
it has delivered. Methods: a part is a method of its brand's class, named by the part's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import coupling, graph
from sparkloom.operators.components import connected_components
from sparkloom.plans.registry import query
from sparkloom.session import table


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, src_path, dst_path)"""
    s = table(spark, sf_dir, "supplier")
    # One row, the number of suppliers, is all that is broadcast.
    s = s.join(F.broadcast(s.agg(F.count("*").alias("n"))))
    to = F.array_compact(F.array(F.when(F.col("s_acctbal") > 0, (F.col("s_suppkey") * 7 + 3) % F.col("n")), F.when(F.col("s_acctbal") < 3000, (F.col("s_suppkey") * 13 + 5) % F.col("n"))))
    return s.select(F.col("s_suppkey").alias("src"), F.explode(to).alias("dst")).filter("src <> dst").distinct()


def named(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("S"), "src").alias("caller"), F.concat(F.lit("S"), "dst").alias("callee"))


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges between paths `nation/supplier`."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("p"))
    e = dependency_edges(spark, sf_dir)
    return e.join(s.select(F.col("s_suppkey").alias("src"), F.col("p").alias("a")), "src").join(s.select(F.col("s_suppkey").alias("dst"), F.col("p").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def method_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods `brand.part name` that call the bare or dotted name of part 7k+3; nations call nations by `x.name`."""
    p = table(spark, sf_dir, "part")
    p = p.join(F.broadcast(p.agg(F.count("*").alias("n"))))
    other = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("callee"))
    calls = p.withColumn("k", (F.col("p_partkey") * 7 + 3) % F.col("n")).join(other, "k")
    own = calls.select(F.concat("p_brand", F.lit("."), "p_name").alias("caller"), F.when(F.col("p_size") > 25, F.concat(F.lit("obj."), "callee")).otherwise(F.col("callee")).alias("callee"))
    n = table(spark, sf_dir, "nation")
    more = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("caller")).join(n.select((F.col("n_nationkey") + 1).alias("k"), F.concat(F.lit("x."), "n_name").alias("callee")), "k").select("caller", "callee")
    return own.unionByName(more).distinct()


DEPS = """n_ AS (SELECT count(*) AS n FROM supplier),
deps AS (
  SELECT DISTINCT src, dst FROM (
    SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % n AS dst FROM supplier, n_ WHERE s_acctbal > 0
    UNION ALL SELECT s_suppkey, (s_suppkey * 13 + 5) % n FROM supplier, n_ WHERE s_acctbal < 3000) WHERE src <> dst),
named AS (SELECT 'S' || src AS caller, 'S' || dst AS callee FROM deps)"""
FILES = (
    DEPS
    + """, paths AS (SELECT s_suppkey AS k, s_nationkey || '/' || s_suppkey AS p, CAST(s_nationkey AS VARCHAR) AS m FROM supplier),
file_edges AS (SELECT a.p AS src, b.p AS dst, a.m AS src_module, b.m AS dst_module FROM deps JOIN paths a ON a.k = src JOIN paths b ON b.k = dst)"""
)
METHODS = """n_ AS (SELECT count(*) AS n FROM part),
edges AS (
  SELECT DISTINCT * FROM (
    SELECT a.p_brand || '.' || a.p_name AS caller, CASE WHEN a.p_size > 25 THEN 'obj.' || b.p_name ELSE b.p_name END AS callee FROM part a, n_ JOIN part b ON b.p_partkey = (a.p_partkey * 7 + 3) % n
    UNION ALL SELECT a.n_name, 'x.' || b.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey + 1)),
keys AS (SELECT DISTINCT caller AS key FROM edges)"""


@query("SELECT DISTINCT 'P' || l_partkey AS callee, 'S' || l_suppkey AS caller FROM lineitem")
def reverse_calls_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return graph.reverse_raw(line.select(F.concat(F.lit("S"), "l_suppkey").alias("caller"), F.concat(F.lit("P"), "l_partkey").alias("callee")))


@query(f"""WITH {METHODS},
split AS (SELECT *, strpos(callee, '.') > 1 AS dotted, regexp_replace(callee, '^[^.]+\\.', '') AS m, CASE WHEN strpos(caller, '.') > 1 THEN split_part(caller, '.', 1) END AS owner FROM edges),
open_ AS (SELECT * FROM split WHERE callee NOT IN (SELECT key FROM keys)),
one AS (SELECT caller, callee, m, CASE WHEN NOT dotted AND owner || '.' || callee IN (SELECT key FROM keys) THEN owner || '.' || callee WHEN dotted AND m IN (SELECT key FROM keys WHERE key NOT LIKE '%.%') THEN m END AS hit FROM open_)
SELECT callee, caller FROM edges UNION SELECT hit, caller FROM one WHERE hit IS NOT NULL
UNION SELECT key, caller FROM one JOIN keys ON strpos(key, '.') > 1 AND regexp_replace(key, '^[^.]+\\.', '') = m WHERE hit IS NULL""")
def reverse_calls_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_resolved(method_edges(spark, sf_dir))


@query(f"WITH {DEPS}, k AS (SELECT 'S' || s_suppkey AS key FROM supplier) SELECT key, coalesce(string_agg(DISTINCT caller, ',' ORDER BY caller), '') AS called_by FROM k LEFT JOIN named ON callee = key GROUP BY key")
def called_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key"))
    got = graph.with_callers(keys, graph.reverse_raw(named(dependency_edges(spark, sf_dir))))
    return got.select("key", F.array_join("called_by", ",").alias("called_by"))


@query(f"WITH {DEPS} SELECT callee FROM named WHERE caller = 'S7'")
def calls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(dependency_edges(spark, sf_dir)).filter("caller = 'S7'").select("callee")


@query(f"WITH {DEPS} SELECT caller FROM named WHERE callee = 'S3'")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(dependency_edges(spark, sf_dir)).filter("callee = 'S3'").select("caller")


@query(f"WITH {DEPS}, b AS (SELECT caller AS node, 0 AS i, 1 AS o FROM named UNION ALL SELECT callee, 1, 0 FROM named) SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM b GROUP BY node")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(named(dependency_edges(spark, sf_dir)))


@query(f"""WITH {FILES} SELECT p AS file, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM file_edges WHERE src = p), '') AS imports,
coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM file_edges WHERE dst = p), '') AS imported_by FROM paths""")
def dependencies_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select(F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"))
    got = graph.dependencies(file_edges(spark, sf_dir), files)
    return got.select("file", F.array_join("imports", ",").alias("imports"), F.array_join("imported_by", ",").alias("imported_by"))


@query(f"""WITH {FILES}, hit AS (SELECT p FROM paths WHERE p = '1/2') SELECT src AS dependent, dst AS file FROM file_edges WHERE dst IN (SELECT p FROM hit UNION SELECT p FROM paths WHERE p LIKE '%1/2%' AND NOT EXISTS (SELECT 1 FROM hit))""")
def file_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = file_edges(spark, sf_dir)
    paths = table(spark, sf_dir, "supplier").select(F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"))
    return edges.join(graph.resolve_file(paths, "1/2"), F.col("dst") == F.col("path"), "left_semi").select(F.col("src").alias("dependent"), F.col("dst").alias("file"))


@query(f"WITH {FILES} SELECT DISTINCT src_module, dst_module FROM file_edges WHERE src_module <> dst_module")
def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_edges(file_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {DEPS},
fwd(node, d) AS (SELECT 'S3', 0 UNION SELECT callee, d + 1 FROM fwd JOIN named ON caller = node WHERE d < 3),
f AS (SELECT node, min(d) AS distance FROM fwd GROUP BY node),
back(node, d) AS (SELECT 'S3', 0 UNION SELECT caller, d + 1 FROM back JOIN named ON callee = node WHERE d < 3 AND caller NOT IN (SELECT node FROM f)),
b AS (SELECT node, min(d) AS distance FROM back WHERE d > 0 GROUP BY node)
SELECT node, CAST(distance AS INTEGER) AS distance, CASE WHEN distance = 0 THEN 'start' ELSE 'calls' END AS side FROM f UNION ALL SELECT node, CAST(distance AS INTEGER), 'callers' FROM b""")
def explore_both_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.explore(named(dependency_edges(spark, sf_dir)), "S3", 3).select("node", "distance", "side")


REACH = """und AS (SELECT caller AS a, callee AS b FROM named UNION SELECT callee, caller FROM named),
reach(a, b) AS (SELECT a, a FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a = r.b),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""
HUBS = """deg AS (SELECT node, sum(i) AS fi, sum(o) AS fo FROM (SELECT caller AS node, 0 AS i, 1 AS o FROM named UNION ALL SELECT callee, 1, 0 FROM named) GROUP BY node),
hubs AS (SELECT node, CAST(fi * 3 + fo * 2 + CASE WHEN s_acctbal > 5000 THEN 5 ELSE 0 END AS BIGINT) AS hub_score FROM deg JOIN supplier ON node = 'S' || s_suppkey)"""


def hub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("S"), "s_suppkey").alias("node"))
    return graph.hub_scores(named(dependency_edges(spark, sf_dir)), exported, exported.filter("false"))


@query(f"WITH {DEPS}, {HUBS} SELECT * FROM hubs")
def hub_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub_scores(spark, sf_dir)


@query(f"WITH RECURSIVE {DEPS}, {REACH}, {HUBS} SELECT component, count(*) AS size, first(node ORDER BY hub_score DESC, node) AS hub, string_agg(node, ',' ORDER BY node) AS members FROM comp JOIN hubs USING (node) GROUP BY component")
def connected_components_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = named(dependency_edges(spark, sf_dir))
    got = graph.component_hubs(connected_components(e, "caller", "callee"), hub_scores(spark, sf_dir))
    return got.withColumn("members", F.array_join("members", ","))


SCC = """reach(a, b) AS (SELECT caller, callee FROM named UNION SELECT r.a, n.callee FROM reach r JOIN named n ON n.caller = r.b),
mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b),
scc AS (SELECT a AS node, least(a, min(b)) AS component FROM mutual GROUP BY a),
inner_ AS (SELECT s.component, caller AS src, callee AS dst FROM named JOIN scc s ON s.node = caller JOIN scc t ON t.node = callee WHERE s.component = t.component)"""


def components_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = named(dependency_edges(spark, sf_dir)).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return e, graph.strongly_connected(e)


@query(f"WITH RECURSIVE {DEPS}, {SCC} SELECT node, component FROM scc")
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {DEPS}, {SCC} SELECT src, dst, component FROM inner_")
def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_edges(*components_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {DEPS}, {SCC}, w AS (SELECT *, CASE WHEN length(src) = length(dst) THEN 1 ELSE 2 END AS weight FROM inner_)
SELECT component, first(src ORDER BY weight, src, dst) AS src, first(dst ORDER BY weight, src, dst) AS dst, min(weight) AS weight FROM w GROUP BY component""")
def cycle_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = graph.cycle_edges(*components_of(spark, sf_dir))
    return graph.minimum_cuts(inner.withColumn("symbols", F.when(F.length("src") == F.length("dst"), 0).otherwise(2)))


@query(f"""WITH {FILES}, cross_ AS (SELECT DISTINCT src_module AS a, dst_module AS b FROM file_edges WHERE src_module <> dst_module),
ms AS (SELECT m AS module, count(*) AS files FROM paths GROUP BY m),
f AS (SELECT CAST(p_size AS BIGINT) AS cx, p_name AS name, p_partkey AS seq, CAST(s_nationkey AS VARCHAR) AS module FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT n FROM n_)),
cx AS (SELECT module, count(*) AS functions, sum(cx) AS total, max(cx) AS max_complexity, first(name ORDER BY cx DESC, seq) AS max_name FROM f GROUP BY module)
SELECT module, files, (SELECT count(*) FROM cross_ WHERE b = module) AS afferent, (SELECT count(*) FROM cross_ WHERE a = module) AS efferent,
  coalesce(floor((SELECT count(*) FROM cross_ WHERE a = module)::DOUBLE / nullif((SELECT count(*) FROM cross_ WHERE a = module OR b = module), 0) * 100 + 0.5) / 100.0::DOUBLE, 0.0::DOUBLE) AS instability,
  CAST(coalesce(functions, 0) AS BIGINT) AS functions, CAST(coalesce(total, 0) AS BIGINT) AS total_complexity, CAST(coalesce(max_complexity, 0) AS BIGINT) AS max_complexity, max_name,
  coalesce(floor(total::DOUBLE / functions * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE, 0.0::DOUBLE) AS avg_complexity FROM ms LEFT JOIN cx USING (module)""")
def module_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    files = s.select(F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"))
    n = F.broadcast(s.agg(F.count("*").alias("n")))
    parts = table(spark, sf_dir, "part").join(n).withColumn("s_suppkey", F.col("p_partkey") % F.col("n")).join(s.select("s_suppkey", "s_nationkey"), "s_suppkey")
    functions = parts.select(F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("file"), F.col("p_name").alias("name"), F.col("p_size").alias("complexity"), F.col("p_partkey").alias("seq"))
    return coupling.module_coupling(files, file_edges(spark, sf_dir), functions)


@query("""WITH RECURSIVE used AS (SELECT DISTINCT p_brand AS c, p_brand || '.' || p_name AS m, l_suppkey AS p FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 9500),
link AS (SELECT DISTINCT a.m AS a, b.m AS b FROM used a JOIN used b ON a.c = b.c AND a.p = b.p),
node AS (SELECT DISTINCT p_brand AS c, p_name AS n, p_brand || '.' || p_name AS m FROM part),
reach(a, b) AS (SELECT m, m FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT c AS class_name, n AS method, min(b) AS cluster FROM node JOIN reach ON a = m GROUP BY ALL""")
def lcom4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a class, a part name a method; it uses the suppliers of its parts, of which the rich are declared."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("v"))
    used = table(spark, sf_dir, "part").join(line, "p_partkey", "left").groupBy(F.col("p_brand").alias("class_name"), F.col("p_name").alias("name")).agg(F.collect_set("v").alias("instance_vars"))
    declared = table(spark, sf_dir, "supplier").filter("s_acctbal > 9500").select(F.col("s_suppkey").cast("string").alias("name"))
    classes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class_name")).distinct()
    return graph.cohesion(used.withColumn("calls", F.array().cast("array<string>")), classes.join(declared))
