"""Operators on literal fixtures, and every registered query against its SQL."""

import importlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import expr, routes
from sparkloom.operators import frameworks, graph, history, quality, recommend, search, usage
from sparkloom.operators.components import connected_components
from sparkloom.plans import all_queries
from sparkloom.snapshot import Snapshot


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def edges(spark, graph_):
    return spark.createDataFrame([(a, b, k) for a, bs in graph_.items() for k, b in enumerate(bs)], "caller string, callee string, pos int")


def pairs(df, a="callee", b="caller"):
    return {(r[a], r[b]) for r in df.collect()}


# --- scalar functions ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("name", "want"),
    [("buildCallGraph", ["build", "call", "graph"]), ("parseURL", ["parse", "url"]), ("URLParser", ["url", "parser"]), ("get_user-name.x/ab", ["get", "user", "name", "ab"]), ("a", []), ("", [])],
)
def test_tokenize(spark, name, want):
    assert one(spark, expr.tokenize(F.col("n")), n=name) == want


def test_paths(spark):
    cases = [("src/a.ts", "./b", "src/b"), ("src/x/a.ts", "../b", "src/b"), ("a.ts", "../../b", "b"), ("src/a.ts", "/abs", "src//abs"), ("a.ts", "./b/./c", "b/c")]
    df = spark.createDataFrame(cases, "i string, s string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", expr.resolve_path(F.col("i"), F.col("s")).alias("got")).collect())
    assert one(spark, expr.module_of(F.col("p")), p="a.py") == "." and one(spark, expr.module_of(F.col("p")), p="a/b/c.py") == "a/b"
    assert one(spark, expr.language_of(F.col("p")), p="x/Y.TSX") == "typescript" and one(spark, expr.language_of(F.col("p")), p="Makefile") is None


def test_globs():
    import re

    assert re.match(expr.glob_pattern("**/conftest.py"), "tests/conftest.py") and not re.match(expr.glob_pattern("**/conftest.py"), "a/b/conftest.py")
    assert re.match(expr.glob_pattern("**/conftest.py", strict=True), "a/b/conftest.py") and re.match(expr.glob_pattern("**/conftest.py"), "conftest.py")


def test_calls(spark):
    calls = ["this.get", "get", "a.b.map", "x", "foo(1).bar", "helper\n.more", "len", "v" * 120, "this.get"]
    assert one(spark, expr.filter_calls(F.col("c")), c=calls) == ["get", "foo", "helper", "v" * 80]
    assert one(spark, expr.call_category(F.col("c")), c="fs.readFile") == "file-io" and one(spark, expr.call_category(F.col("c")), c="nothing") is None


def test_half_up_and_score(spark):
    assert one(spark, expr.half_up(F.col("x"), 2), x=1.005) == 1.0
    score = expr.health_score(*[F.col(c) for c in "abcdef"])
    assert one(spark, score, a=100, b=10, c=0, d=0, e=0, f=0) == 100
    assert one(spark, score, a=10, b=1, c=10, d=10, e=1, f=10) == 30
    assert one(spark, score, a=0, b=0, c=0, d=0, e=0, f=0) == 100


def test_routes(spark):
    cases = {
        "nuxt_page": [("pages/index.vue", "/"), ("src/pages/a/[id].vue", "/a/:id"), ("pages/[[...slug]].vue", "/:slug(.*)*"), ("pages/[[id]].vue", "/:id?"), ("pages/a/index.vue", "/a")],
        "nuxt_server": [("server/api/users/[id].ts", "/api/users/:id"), ("server/routes/index.js", "/api/")],
        "next_page": [("pages/index.tsx", "/"), ("src/pages/b/[...all].jsx", "/b/:all(.*)"), ("pages/[[...x]].ts", "/:x(.*)?")],
        "next_app": [("app/page.tsx", "/"), ("src/app/(shop)/cart/[id]/page.tsx", "/cart/:id"), ("app/api/x/route.ts", "/api/x")],
        "component_name": [("components/base/button.vue", "BaseButton")], "composable_name": [("composables/useAuth.ts", "useAuth")],
        "plugin_name": [("plugins/my.client.ts", "my")], "plugin_mode": [("plugins/my.client.ts", "client"), ("plugins/x.ts", "universal")], "layout_name": [("layouts/default.vue", "default")],
    }
    for name, rows in cases.items():
        for path, want in rows:
            assert one(spark, getattr(routes, name)(F.col("p")), p=path) == want, (name, path)


# --- graphs ----------------------------------------------------------------------------------------------


def test_reverse_resolution(spark):
    own = graph.reverse_resolved(edges(spark, {"MyClass.process": ["validate"], "MyClass.validate": ["x"]}))
    assert ("MyClass.validate", "MyClass.process") in pairs(own)
    instance = graph.reverse_resolved(edges(spark, {"main": ["logger.success"], "Logger.success": ["x"]}))
    assert ("Logger.success", "main") in pairs(instance) and ("logger.success", "main") in pairs(instance)
    plain = graph.reverse_resolved(edges(spark, {"caller": ["utils.foo"], "foo": ["x"], "K.foo": ["y"]}))
    assert ("foo", "caller") in pairs(plain) and ("K.foo", "caller") not in pairs(plain)
    twice = graph.reverse_resolved(edges(spark, {"caller": ["target", "target"], "target": ["z"]}))
    assert [r for r in twice.collect() if r["callee"] == "target"] == [("target", "caller")]
    every = graph.with_callers(spark.createDataFrame([("a",), ("target",)], "key string"), twice)
    assert {r["key"]: r["called_by"] for r in every.collect()} == {"a": [], "target": ["caller"]}


def test_import_resolution(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("src/b/index.ts",), ("src/c.py",), ("d.js",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "./b", 1), ("src/a.ts", "../d.js", 2), ("src/a.ts", "react", 3), ("src/a.ts", "./none", 4), ("src/a.ts", "./c.py", 5)], "file string, specifier string, seq int")
    assert pairs(graph.import_edges(files, imports), "src", "dst") == {("src/a.ts", "src/b.ts"), ("src/a.ts", "d.js"), ("src/a.ts", "src/c.py")}


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("g", "g")], "src string, dst string")
    found = graph.strongly_connected(e)
    assert pairs(found, "node", "component") == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")}
    inner = graph.cycle_edges(e, found)
    assert inner.count() == 5
    cuts = graph.minimum_cuts(inner.withColumn("symbols", F.when(F.col("src") == "d", 0).otherwise(3)))
    assert {tuple(r) for r in cuts.collect()} == {("a", "a", "b", 3), ("c", "d", "e", 1)}
    none = graph.strongly_connected(e.filter("src = 'c'"))
    assert none.count() == 0 and none.columns == ["node", "component"]


def test_components(spark):
    e = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 100), (200, 200), (300, 301), (300, 302)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "src int, dst int")).collect()}
    assert got == {**{k: 0 for k in [*range(41), 100, 101]}, 200: 200, **{k: 300 for k in (300, 301, 302)}}


def test_explore(spark):
    e = edges(spark, {"a": ["b", "c"], "b": ["d"], "x": ["a"], "d": ["a"]})
    both = {(r["node"], r["distance"], r["side"]) for r in graph.explore(e, "a", 2).collect()}
    assert both == {("a", 0, "start"), ("b", 1, "calls"), ("c", 1, "calls"), ("d", 2, "calls"), ("x", 1, "callers")}
    assert graph.explore(e, "nobody").count() == 0 and graph.explore(e, "c", 1, "callers").count() == 2


def test_search_clusters(spark):
    results = spark.createDataFrame([(1, "processAuth"), (2, "validateToken"), (3, "decodeJWT"), (4, "getUser"), (5, "alone")], "rank int, name string")
    got = graph.search_clusters(results, edges(spark, {"processAuth": ["validateToken", "getUser"], "validateToken": ["decodeJWT"], "alone": ["other"]}))
    assert {(r["name"], r["root"], r["size"]) for r in got.collect()} == {(n, "processAuth", 4) for n in ("processAuth", "validateToken", "decodeJWT", "getUser")} | {("alone", "alone", 1)}


def test_cohesion(spark):
    m = spark.createDataFrame([("K", "a", ["x"], []), ("K", "b", ["x", "z"], []), ("K", "c", ["z"], ["d"]), ("K", "d", [], [])], "class_name string, name string, instance_vars array<string>, calls array<string>")
    p = spark.createDataFrame([("K", "x")], "class_name string, name string")
    got = graph.cohesion(m, p).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [2, 2]


# --- search, quality, recommendations --------------------------------------------------------------------


def test_ranked_search(spark):
    names = ["buildCallGraph", "buildReverseCallGraph", "sendEmail", "_callGraph", "GraphHelper"]
    e = spark.createDataFrame([("function", n, "src/a.ts", True, 7, k) for k, n in enumerate(names)], "kind string, name string, file string, exported boolean, callers int, seq int")
    got = [r["name"] for r in search.ranked(e, "call graph").collect()]
    assert got == ["buildCallGraph", "buildReverseCallGraph", "_callGraph", "GraphHelper"] and search.ranked(e, "  ").count() == 0
    assert search.lookup(e, "sendEmail").first()["name"] == "sendEmail" and search.lookup(e, "sendMail").count() == 1


def rows_of_callables(spark, rows):
    base = "file string, name string, class_name string, qualified_name string, kind string, param_count int, param_signature string, return_type string, access string, exported boolean, calls array<string>, complexity int, line_count int, nesting_depth int, seq int"
    made = [(f, n.split(".")[-1], n.split(".")[0] if "." in n else None, n, "method" if "." in n else "function", 1, sig, "void", "public", x, c, cx, lc, 1, k) for k, (f, n, sig, x, c, cx, lc) in enumerate(rows)]
    return spark.createDataFrame(made, base)


def test_dead_code_and_health(spark):
    c = rows_of_callables(spark, [("a.ts", "used", "", True, [], 5, 10), ("a.ts", "lost", "", False, [], 25, 60), ("b.ts", "helperA", "", False, [], 1, 4), ("b.ts", "K.__init__", "", True, [], 1, 1), ("main.py", "start", "", False, [], 1, 1), ("b.ts", "K.open", "", True, [], 1, 9)])
    reverse = spark.createDataFrame([("used", "lost")], "callee string, caller string")
    dead = quality.dead_functions(c, reverse, spark.createDataFrame([("main.py",)], "file string"), spark.createDataFrame([("helperA",)], "name string"))
    assert {(r["qualified_name"], r["confidence"]) for r in dead.collect()} == {("lost", "high"), ("helperA", "low"), ("K.open", "low")}
    report = quality.health(c, c.select("class_name").distinct().dropna(), dead).first()
    assert report["total_functions"] == 6 and report["over_complexity"] == 1 and report["max_function"] == "lost" and report["dead"] == 3 and report["percentage"] == 50.0
    assert quality.hotspots(c).first()["severity"] == "critical"
    gate = quality.gate(quality.health(c, c.select("class_name").distinct(), dead), 95).first()
    assert not gate["passed"]
    plan = recommend.report(recommend.dead_code(dead), recommend.hotspots(quality.hotspots(c)))
    assert plan.count() == 3 and plan.first()["priority"] == "critical" and recommend.summary(plan).first()["total"] == 3


def test_duplicates(spark):
    rows = [
        ("a.ts", "formatDate", "d:Date", True, ["x", "y"], 3, 10), ("b.ts", "formatDate", "d:Date", True, ["x", "y"], 3, 10),
        ("a.ts", "check", "a:1", True, ["checkType", "checkNull", "checkRange"], 1, 5), ("b.ts", "check", "b:2", True, ["checkType", "checkNull", "formatError"], 1, 5),
        ("c.ts", "helper", "", True, ["x"], 1, 5), ("c.ts", "helper", "", True, ["x"], 1, 5), ("d.ts", "other", "", True, ["q"], 1, 5), ("e.ts", "other", "", True, ["r"], 1, 5),
    ]
    groups = {r["base"]: r["max_similarity"] for r in quality.same_name_groups(rows_of_callables(spark, rows)).collect()}
    assert groups == {"formatDate": 1.0, "check": 0.5}
    cross = [("a.ts", "one", "d:Date", True, ["x", "y"], 3, 10), ("b.ts", "two", "d:Date", True, ["x", "y"], 3, 10), ("c.ts", "three", "d:Date", True, ["x", "y"], 3, 60), ("d.ts", "four", "z:Q", True, [], 1, 5), ("e.ts", "five", "w:Q", True, [], 1, 5)]
    got = {(r["name_a"], r["name_b"]): r["similarity"] for r in quality.cross_name_pairs(rows_of_callables(spark, cross)).collect()}
    assert got == {("one", "two"): 0.93, ("four", "five"): 0.83}


def test_cross_name_pairs_are_those_of_all_pairs(spark):
    names = ["readFile", "writeFile", *(f"f{k}" for k in range(14))]
    rows = [(f"{k % 5}.ts", f"n{k % 70}", ["", "a:A", "b:B"][k % 3], True, [names[(k * j + j * j) % 16] for j in range(k % 7)], 1 + k % 4, 3 + k % 9) for k in range(90)]
    c = rows_of_callables(spark, rows).withColumn("return_type", F.element_at(F.array(F.lit("v"), F.lit("w"), F.lit("")), (F.col("seq") % 3 + 1).cast("int")))
    c = c.withColumn("param_count", F.when(F.col("param_signature") == "", 0).otherwise(1)).cache()
    full = c.withColumn("categories", F.array_distinct(F.filter(F.transform("calls", expr.call_category), lambda x: x.isNotNull())))
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    every = full.alias("a").join(full.alias("b"), (a("seq") < b("seq")) & (a("file") != b("file")) & (a("name") != b("name")) & (F.greatest(a("line_count"), b("line_count")) <= 2 * F.least(a("line_count"), b("line_count"))))
    scored = [(r["x"], r["y"], r["s"]) for r in every.select(a("seq").alias("x"), b("seq").alias("y"), expr.similarity(a, b).alias("s")).collect()]
    name = {k: r[1] for k, r in enumerate(rows)}
    for least in (0.56, 0.6, 0.7):
        want = sorted((name[x], name[y]) for x, y, s in scored if s >= least)
        got = sorted((r["name_a"], r["name_b"]) for r in quality.cross_name_pairs(c, least=least).collect())
        assert len(want) > 20 and got == want, least


def test_cross_name_candidates_need_more_than_parameters_or_one_call(spark):
    """Equal parameters alone, or one call of many, can't reach 0.6: such pairs never leave the join."""
    rows = [(f"{k}.ts", f"n{k}", "a:A" if k < 200 else f"p{k}", True, ["hot", *(f"c{k}x{j}" for j in range(24))][k < 200 :], 1, 5) for k in range(400)]
    c = rows_of_callables(spark, rows).withColumn("categories", F.array().cast("array<string>"))
    assert quality.alike_candidates(c, 0.6).count() < 400


def test_synthetic_callers_and_frameworks(spark):
    c = spark.createDataFrame([("m.py", "__init__", "User.__init__", []), ("m.py", "save", "User.save", []), ("t/conftest.py", "db", "db", []), ("w.py", "job", "job", ["@shared_task(bind=True)"])], "file string, name string, qualified_name string, decorators array<string>")
    got = pairs(frameworks.synthetic_edges(c, ["celery", "pytest"], [("__me__", [], ["^save$"], [])]), "caller", "callee")
    assert got == {("__runtime__", "User.__init__"), ("__pytest__", "db"), ("__celery__", "job"), ("__me__", "User.save")}
    m = spark.createDataFrame(
        [("p", "", "package.json", '{"dependencies":{"vue":"3","nuxt":"3"},"devDependencies":{"express":"4"}}'), ("p", "api", "requirements.txt", "FastAPI\npydantic"), ("p", "w", "package.json", '{"dependencies":{"vue":"3"}}'), ("p", "w", "manage.py", "")],
        "project string, folder string, path string, content string",
    )
    assert {r["framework"] for r in frameworks.detect(m).collect()} == {"nuxt", "express", "fastapi", "vue", "django"}


def test_django_and_fastapi(spark):
    classes = spark.createDataFrame([("m.py", "Post", "models.Model", None), ("f.py", "PostForm", "ModelForm", ["Mixin"]), ("app/management/commands/load.py", "Command", "BaseCommand", None)], "file string, name string, extends string, implements array<string>")
    assert pairs(frameworks.class_kinds(classes), "name", "kind") == {("Post", "model"), ("PostForm", "form")}
    fields = spark.createDataFrame([("m.py", "Post", "author", "models.ForeignKey(User, on_delete=CASCADE)", "public"), ("m.py", "Post", "title", "CharField", "public")], "file string, class_name string, name string, type string, access string")
    assert {(r["field"], r["type"], r["relationship"], r["related"]) for r in frameworks.model_fields(classes, fields).collect()} == {("author", "ForeignKey", "foreign_key", "User"), ("title", "CharField", None, None)}
    assert frameworks.django_commands(classes).first()["name"] == "load"
    param = "array<struct<name:string,type:string,optional:boolean,default:string>>"
    calls = spark.createDataFrame([("r.py", "read", "read", ["@router.get('/items/{id}', response_model=List[Item], status_code=200)"], [("u", "User", True, "Depends(get_current_user)")]), ("s.py", "on_save", "on_save", ["@receiver(post_save, sender=Post)"], []), ("d.py", "get_current_user", "get_current_user", [], [])], f"file string, name string, qualified_name string, decorators array<string>, params {param}")
    r = frameworks.fastapi_routes(calls).first()
    assert (r["methods"], r["path"], r["response_model"], r["dependencies"], r["auth"]) == (["GET"], "/items/{id}", "List[Item]", ["get_current_user"], True)
    assert tuple(frameworks.django_signals(calls).first()) == ("s.py", "on_save", "post_save", "Post")
    assert frameworks.dependency_providers(calls, frameworks.fastapi_routes(calls)).first()["used_by"] == ["read"]


def test_next_and_nuxt_files(spark):
    df = spark.createDataFrame([("pages/index.tsx",), ("pages/_app.tsx",), ("pages/api/x.ts",), ("app/a/page.tsx",), ("app/a/route.ts",), ("lib/x.ts",)], "file string")
    assert {(r["route"], r["kind"]) for r in frameworks.next_routes(df).collect()} == {("/", "page"), ("/api/x", "api"), ("/a", "page"), ("/a", "api")}
    nuxt = spark.createDataFrame([("pages/[id].vue",), ("stores/user.ts",), ("server/api/a.ts",)], "file string")
    assert {(r["kind"], r["name"]) for r in frameworks.nuxt_files(nuxt).collect()} == {("pages", "/:id"), ("stores", "user"), ("server_api", "/api/a")}


# --- metering, history, streaming ------------------------------------------------------------------------

EVENT = "session_id string, tool string, started_at timestamp, latency_ms double, is_error boolean, response_bytes long, params map<string,string>, seq long"


def test_usage_average_is_a_running_one(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1, 4, 59)
    rows = [("s", "q", t + datetime.timedelta(minutes=k), 10.0 + k, k == 2, b, {"name": "x" if k < 3 else "y" * 300}, k) for k, b in enumerate([100, 200, 0, 0])]
    df = spark.createDataFrame(rows, EVENT)
    r = usage.by_tool(df).first()
    assert (r["calls"], r["errors"], r["total_bytes"], r["avg_bytes"], r["min_bytes"], r["avg_latency"]) == (4, 1, 300, 150, 100, 12)
    assert [(x["value"], x["n"]) for x in usage.parameter_values(df).collect()] == [("x", 3)]
    assert {(x["bucket"].hour, x["bucket_end"].hour, x["calls"]) for x in usage.buckets(df).collect()} == {(0, 5, 1), (5, 10, 3)}


def test_streaming_equals_batch(spark, tmp_path):
    import datetime

    from sparkloom.streaming import usage_stream

    t = datetime.datetime(2024, 1, 1)
    rows = [("s", "q" if k % 3 else "r", t + datetime.timedelta(hours=k), 1.0, k % 4 == 0, 1, {}, k) for k in range(60)]
    df = spark.createDataFrame(rows, EVENT)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = usage_stream.bucket_counts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in"))
    usage_stream.flush(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r["bucket"], r["tool"], r["calls"], r["errors"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r["bucket"], r["tool"], r["calls"], r["errors"]) for r in usage.buckets(df, "tool").collect()}


def test_history(spark):
    def rows(*scores):
        return spark.createDataFrame([(k, s, s * 2, 5) for k, s in enumerate(scores)], "ts int, score int, dead int, total_functions int")

    assert history.trend(rows(80)).count() == 0
    assert history.trend(rows(80, 82)).first()["direction"] == "stable" and history.trend(rows(80, 83)).first()["direction"] == "improving"
    assert history.degrading_since(rows(70, 90, 80, 70)).first()["since"] == 1 and history.degrading_since(rows(1, 2)).count() == 0
    assert [(r["metric"], r["delta"], r["direction"]) for r in history.movers(rows(10, 20), ["dead", "total_functions"]).collect()] == [("dead", 20.0, "worse")]


# --- snapshot and queries --------------------------------------------------------------------------------


def test_snapshot_of_a_tree(spark, tmp_path):
    tree = {
        "src/a.ts": "import { beta } from './b';\nexport function alpha() { return beta(); }\nfunction unused() { return 1; }\n",
        "src/b.ts": "import { alpha } from './a';\nexport class B { x: number;\n  one() { return this.x; }\n  two() { return this.one(); } }\nexport function beta() { return new B(); }\n",
        "lib/c.py": "class C:\n    def __init__(self): pass\n    def run(self): self.go()\n    def go(self): pass\n",
    }
    for path, text in tree.items():
        (tmp_path / "t" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / path).write_text(text)
    Snapshot.build(spark, f"{tmp_path}/t").write(f"{tmp_path}/s")
    s = Snapshot.read(spark, f"{tmp_path}/s")
    assert pairs(s["import_edges"], "src", "dst") == {("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts")}
    assert {r["qualified_name"] for r in s.dead_code().collect()} >= {"unused", "alpha"} and "C.go" not in {r["qualified_name"] for r in s.dead_code().collect()}
    assert {r["component"] for r in s.cycles()[0].collect()} == {"src/a.ts"} and s.cycles()[1].count() == 1
    assert s.search("run").first()["name"] == "C.run" and s.query("beta").first()["kind"] == "function" and s.callers("beta").first()["caller"] == "alpha"
    assert {r["module"] for r in s.coupling().collect()} == {"src", "lib"} and s.health().first()["total_functions"] == 8
    assert s.recommendations().count() >= 1 and s.diff(s).count() == 0 and s.dependencies("a.ts").count() == 1
    assert {r["cluster"] for r in s.cohesion().filter("class_name = 'B'").collect()} == {"B.one"} and s.overview().count() >= 3


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()[1]))
def test_query_equals_sql(spark, duck, name):
    queries, sql = all_queries()
    got = queries[name](spark, "/root/testdata/sf0.001")
    want = duck.sql(sql[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    place = [list(want.columns).index(c) for c in columns]
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    left = sorted(repr([near(r[c]) for c in columns]) for r in got.collect())
    assert left == sorted(repr([near(r[k]) for k in place]) for r in want.fetchall())


def test_entry_imports_without_the_subpackage(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith(("sparkloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(all_queries()[0]) and set(entry.oracle_sql()) == set(all_queries()[1])
    monkeypatch.delitem(sys.modules, "__spark_entry__")
