"""The rest of the framework operators, rendering and the command line."""

import pytest
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.operators import frameworks, render
from sparkloom.snapshot import Registry, Snapshot

PARAM = "array<struct<name:string,type:string,optional:boolean,default:string>>"
CALLABLE = f"file string, name string, class_name string, qualified_name string, decorators array<string>, calls array<string>, params {PARAM}, exported boolean, return_type string, complexity int, line_count int"


def callables(spark, *rows):
    made = []
    for file, qualified, more in rows:
        owner, _, name = qualified.rpartition(".")
        base = {"decorators": [], "calls": [], "params": [], "exported": True, "return_type": "", "complexity": 1, "line_count": 3} | more
        made.append((file, name, owner or None, qualified, base["decorators"], base["calls"], base["params"], base["exported"], base["return_type"], base["complexity"], base["line_count"]))
    return spark.createDataFrame(made, CALLABLE)


def classes(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, name string, extends string, implements array<string>, decorators array<string>")


def found(df, *columns):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in columns)) for r in df.collect()}


def test_django_parts(spark):
    request = [("request", "any", False, None)]
    c = callables(
        spark, ("v.py", "Page.get", {}), ("v.py", "Page.post", {}), ("v.py", "home", {"params": request, "calls": ["render"]}), ("v.py", "api", {"decorators": ["@api_view(['get', 'POST'])"]}), ("v.py", "plain", {"params": request}),
        ("m.py", "Own.__init__", {}), ("m.py", "Own.__call__", {}), ("f.py", "UserForm.clean_name", {}), ("app/templatetags/x.py", "money", {"decorators": ["@register.filter(name='m')"]}), ("app/templatetags/x.py", "box", {"decorators": ["@register.tag"]}),
    )
    k = classes(spark, ("v.py", "Page", "TemplateView", [], []), ("m.py", "Log", "MiddlewareMixin", [], []), ("m.py", "Own", None, [], []), ("f.py", "UserForm", "forms.ModelForm", [], []), ("a.py", "UserAdmin", "admin.ModelAdmin", [], ["@admin.register(User)"]), ("a.py", "PostAdmin", "ModelAdmin", [], []))
    assert found(frameworks.django_views(k, c), "view", "methods", "kind") == {("Page", ("GET", "POST"), "class"), ("home", ("ALL",), "function"), ("api", ("GET", "POST"), "function")}
    assert found(frameworks.django_middleware(k, c), "name") == {("Log",), ("Own",)}
    assert found(frameworks.forms(k, c), "form", "validators") == {("UserForm", ("clean_name",))}
    assert found(frameworks.template_tags(c), "name", "kind") == {("money", "filter"), ("box", "block_tag")}
    calls = spark.createDataFrame([("a.py", "admin.site.register(Post, PostAdmin)")], "file string, call string")
    assert found(frameworks.admin_registrations(k, c, calls), "admin", "model") == {("UserAdmin", "User"), ("PostAdmin", "Post")}


def test_fastapi_parts(spark):
    params = [("id", "int", False, None), ("q", "str = Query(None)", False, "None"), ("body", "Body", False, None), ("user", "User = Depends(me)", False, None)]
    c = callables(spark, ("r.py", "read", {"decorators": ["@app.get('/x')"], "params": params}), ("r.py", "start", {"decorators": ["@app.on_event('startup')"]}), ("r.py", "timer", {"decorators": ["@app.middleware('http')"]}), ("r.py", "oops", {"decorators": ["@app.exception_handler(E)"]}))
    assert found(frameworks.fastapi_params(c), "name", "required", "location") == {("id", True, "query"), ("q", False, "query"), ("body", True, "body")}
    assert found(frameworks.fastapi_hooks(c), "key", "kind") == {("event:start", "startup"), ("timer", "middleware"), ("exception:oops", "exception_handler")}


def test_nuxt_parts(spark):
    pages = spark.createDataFrame([("p/a.vue", "definePageMeta({ layout: 'wide', middleware: ['auth', \"x\"] })"), ("p/b.vue", "definePageMeta({ middleware: 'one' })"), ("p/c.vue", "")], "file string, content string")
    meta = frameworks.page_meta(pages)
    assert found(meta, "file", "layout", "middleware") == {("p/a.vue", "wide", ("auth", "x")), ("p/b.vue", None, ("one",))}
    layouts = spark.createDataFrame([("wide", "layouts/wide.vue"), ("bare", "layouts/bare.vue")], "name string, file string")
    assert found(frameworks.used_by(layouts, meta.select("file", F.col("layout").alias("name"))), "name", "used_by") == {("wide", ("p/a.vue",)), ("bare", ())}
    c = callables(spark, ("p/a.vue", "load", {"calls": ["MyCard", "fetchIt", "A.b"]}), ("stores/u.ts", "useUser", {"calls": ["defineStore"]}), ("x.ts", "y", {"calls": ["defineStore"]}))
    assert found(frameworks.component_uses(c), "name") == {("MyCard",)}
    imports = spark.createDataFrame([("stores/u.ts", "pinia")], "file string, specifier string")
    assert found(frameworks.pinia_stores(c, imports), "file", "stores") == {("stores/u.ts", ("useUser",))}
    got = spark.range(1).select(frameworks.plain_vue(F.lit("const p = withDefaults(defineProps<A>(), {}); defineEmits(['x'])")).alias("x")).first()["x"]
    assert got == "const p = __withDefaults( {}); __defineEmits(['x'])"


def test_render(spark):
    df = spark.createDataFrame([([f"n{k}" for k in range(n)],) for n in (3, 25)], "names array<string>").select(render.first_of(F.col("names")).alias("x")).collect()
    assert df[0]["x"] == "n0, n1, n2" and df[1]["x"].endswith("n14 ... +10 more")
    c = callables(spark, ("s/a.ts", "K.go", {"params": [("a", "int", False, None), ("b", "any", False, None)], "return_type": "str", "complexity": 4, "line_count": 9}), ("s/a.ts", "run", {}))
    lines = {r["x"] for r in c.select(render.callable_line().alias("x")).collect()}
    assert lines == {".go(a:int,b)→str @s/a.ts cx:4 ln:9", "fn run() @s/a.ts exp cx:1 ln:3"}
    assert {r["x"] for r in c.select(render.callable_line("summary").alias("x")).collect()} == {".go @s/a.ts", "fn run @s/a.ts exp"}
    paths = lambda *p: render.common_folder(spark.createDataFrame([(x,) for x in p], "path string")).first()["prefix"]
    assert (paths("a/b/c.ts", "a/b/d/e.ts"), paths("a.ts", "b/c.ts"), paths("x/y.ts")) == ("a/b/", "", "x/")
    page = render.module_pages(c.withColumn("module", F.lit("s")).withColumn("seq", F.col("name"))).first()["page"]
    assert page == "# s\n\n## s/a.ts\n- `K.go` (4, 9 lines) exported\n- `run` (1, 3 lines) exported"
    stats = spark.createDataFrame([("s", 1, 0, 2, 0)], "module string, files int, classes int, functions int, types int")
    assert render.root_page("t", stats).first()["page"] == "# t\n\n## MODULES\ns/ (1f, 2fn)"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.py").write_text("def start():\n    return helper()\n\ndef helper():\n    return 1\n")
    assert cli.main(["generate", f"{tmp_path}/t", f"{tmp_path}/s"]) == 0
    assert cli.main(["query", f"{tmp_path}/s", "callers", "helper", "--json"]) == 0
    assert '{"caller":"start"}' in capsys.readouterr().out
    assert cli.main(["health", f"{tmp_path}/s", "--threshold", "1"]) == 0 and cli.main(["health", f"{tmp_path}/s", "--threshold", "101"]) == 1
    assert cli.main(["diff", f"{tmp_path}/s", f"{tmp_path}/s"]) == 0 and cli.main(["analyze", f"{tmp_path}/s", "dead-code", "--json"]) == 0
    assert "start" in capsys.readouterr().out


def test_registry(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.py").write_text("def start():\n    return 1\n")
    Snapshot.build(spark, f"{tmp_path}/t").write(f"{tmp_path}/one")
    r = Registry(spark, {"x": f"{tmp_path}/one"})
    assert r.resolve() == "x" and r.resolve("one") == "x" and r.snapshot() is r.snapshot("x")
    assert [tuple(row) for row in r.status().collect()] == [("x", 1, 1, 0)]
    for wanted in ("y", None):
        with pytest.raises(ValueError):
            Registry(spark, {"x": "/p/one", "z": "/q/two"}).resolve(wanted)
