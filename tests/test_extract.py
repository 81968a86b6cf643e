"""Extractors on small sources of each language."""

from pyspark.sql import functions as F

from sparkloom.sources import extract, files

PY = '''
import os, json as j
from .util import helper, other as o
KEY = os.environ["API_KEY"]; B = os.getenv('B')
class Base: pass
@dataclass
class User(Base, Mixin):
    name: str = "x"
    _age = 3
    def __init__(self, a): self.a = a
    @staticmethod
    def make(n: int, *rest, flag=True, **kw) -> "User":
        if n and flag or rest:
            return helper(n)
        elif n > 2:
            for x in rest:
                self.name
        return [i for i in rest]
    async def save(self): self.validate(); json.dumps(self.a)
def _hidden(): return 1
def shown(x, y: int = 2): return _hidden()
Point = NamedTuple("Point", [])
'''
TS = '''
import React, { useState as s, type A } from 'react';
import * as path from "path";
export interface Shape extends Base, Other { a: number }
export enum Color { Red }
type Id = string;
const url = process.env.API_URL || process.env['KEY'];
const app = express();
@Injectable()
export class Service extends Core<string> implements One, Two {
  private name: string = "if (";
  constructor(a: string) { this.name = a; }
  @Get('/x')
  public async load(id: number, opts?: Options): Promise<string> {
    // if (comment) while
    if (id > 1 && opts) { for (const x of opts.list) { this.helper(x); } }
    return this.name ?? fetchIt(id);
  }
  static make() { return new Service(''); }
}
export function run(a: string, b = 2): void {
  try { go(a); } catch (e) { log(e) }
}
const arrow = async (x: number) => { if (x) { run(x); } };
export const short = (x) => helper(x);
'''
GO = '''
package main
import (
  "fmt"
  str "strings"
)
import "os"
type Server struct {
  Base
  Port, max int
}
type Reader interface { Read(p []byte) int }
type Id string
func (s *Server) Start(a, b int, c string) error {
  for i := 0; i < 3; i++ { if a > b { s.stop(); fmt.Println(os.Getenv("HOME")) } }
  return nil
}
func (l *Late) do() {}
func New(int) *Server { return nil }
'''
RUST = '''
use std::{fs::{self, File}, io::*};
use a::b as c;
pub struct Point<'a> { pub x: i32, y: &'a str }
pub trait Draw: Base { fn draw(&self) -> i32; }
enum Kind { A, B }
impl<'a> Point<'a> {
  pub fn new(x: i32) -> Self { Point { x, y: "a { b" } }
  async fn go(&self, n: usize) -> Result<i32, String> where i32: Copy {
    match n { 1 => helper(n), _ => { if n > 2 { self.other(); } 0 } };
    vec![1]; println!("x"); env::var("HOME")
  }
}
impl Draw for Point<'_> { fn draw(&self) -> i32 { 1 } }
macro_rules! mine { () => {} }
'''
VUE = '''<script lang="ts">export default {}</script>
<script setup lang="ts">
import x from './x'
const load = () => { fetchAll() }
</script>
<template><MyCard/><base-button></base-button></template>'''


def by_name(record):
    return {(c["class_name"], c["name"]): c for c in record["callables"]}


def test_python():
    r = extract.python(PY)
    c = by_name(r)
    make = c["User", "make"]
    assert [p["name"] for p in make["params"]] == ["n", "*rest", "flag", "**kw"] and make["is_static"] and make["return_type"] == "'User'"
    assert make["complexity"] == 1 + 2 + 2 + 1 + 1 and make["nesting_depth"] == 2 and make["calls"] == ["helper"] and make["instance_vars"] == ["name"]
    assert c["User", "save"]["is_async"] and c["User", "save"]["calls"] == ["validate", "json.dumps"]
    assert [x for x in r["classes"] if x["name"] == "User"] == [{"name": "User", "extends": "Base", "implements": ["Mixin"], "decorators": ["@dataclass"]}]
    assert {(p["name"], p["type"], p["access"]) for p in r["properties"]} == {("name", "str", "public"), ("_age", "unknown", "private")}
    assert {e["name"] for e in r["exports"]} == {"shown", "User", "Base"} and r["env_vars"] == ["API_KEY", "B"]
    assert {"specifier": ".util", "symbols": ["helper", "o"], "is_default": False, "is_namespace": False} in r["imports"]
    assert r["types"] == [{"name": "Point", "kind": "type", "extends": []}]


def test_typescript():
    r = extract.typescript(TS)
    c = by_name(r)
    load = c["Service", "load"]
    assert load["is_async"] and load["access"] == "public" and load["decorators"] == ["@Get('/x')"] and load["return_type"] == "Promise<string>"
    assert load["complexity"] == 5 and load["nesting_depth"] == 2 and load["calls"] == ["helper", "fetchIt"]
    assert [(p["name"], p["optional"]) for p in load["params"]] == [("id", False), ("opts", True)]
    assert c["Service", "make"]["is_static"] and ("Service", "constructor") not in c
    assert c[None, "run"]["exported"] and c[None, "run"]["complexity"] == 2 and c[None, "run"]["calls"] == ["go", "log"]
    assert c[None, "arrow"]["is_async"] and not c[None, "arrow"]["exported"] and c[None, "short"]["calls"] == ["helper"]
    assert r["classes"] == [{"name": "Service", "extends": "Core", "implements": ["One", "Two"], "decorators": ["@Injectable()"]}]
    assert ("Service", "name") in {(p["class_name"], p["name"]) for p in r["properties"]}
    assert {(i["specifier"], tuple(i["symbols"])) for i in r["imports"]} == {("react", ("React", "useState", "A")), ("path", ("path",))}
    assert {t["name"] for t in r["types"]} == {"Shape", "Color", "Id"} and r["env_vars"] == ["API_URL", "KEY"]
    assert "express" in r["module_calls"] and {"run", "Service", "Shape", "short"} <= {e["name"] for e in r["exports"]}


def test_go():
    r = extract.go(GO)
    c = by_name(r)
    start = c["Server", "Start"]
    assert [(p["name"], p["type"]) for p in start["params"]] == [("a", "int"), ("b", "int"), ("c", "string")]
    assert start["return_type"] == "error" and start["complexity"] == 3 and start["nesting_depth"] == 2 and start["calls"][:2] == ["stop", "fmt.Println"]
    assert {x["name"] for x in r["classes"]} == {"Server", "Late"} and r["classes"][0]["extends"] == "Base"
    assert {(p["name"], p["access"]) for p in r["properties"]} == {("Port", "public"), ("max", "private")}
    assert {(i["specifier"], i["symbols"][0]) for i in r["imports"]} == {("fmt", "fmt"), ("strings", "str"), ("os", "os")}
    assert c[None, "New"]["params"][0]["name"] == "_" and r["env_vars"] == ["HOME"] and {t["name"] for t in r["types"]} == {"Reader", "Id"}


def test_rust():
    r = extract.rust(RUST)
    c = by_name(r)
    assert c["Point", "new"]["is_static"] and c["Point", "new"]["return_type"] == "Self" and c["Point", "new"]["params"] == [{"name": "x", "type": "i32", "optional": False, "default": None}]
    go = c["Point", "go"]
    assert go["is_async"] and not go["is_static"] and go["complexity"] >= 4 and go["return_type"] == "Result<i32, String>" and {"helper", "other", "println", "env::var"} <= set(go["calls"])
    assert r["classes"] == [{"name": "Point", "extends": None, "implements": ["Draw"], "decorators": []}]
    assert {(i["specifier"], i["symbols"][0]) for i in r["imports"]} == {("std::fs", "fs"), ("std::fs", "File"), ("std::io", "*"), ("a::b", "c")} or {i["symbols"][0] for i in r["imports"]} >= {"File", "*", "c"}
    assert (None, "macro:mine") in c and r["env_vars"] == ["HOME"] and {t["name"] for t in r["types"]} == {"Draw", "Kind"}


def test_vue():
    c = by_name(extract.vue(VUE))
    assert c[None, "load"]["calls"] == ["fetchAll", "MyCard", "BaseButton"]


def test_scan_and_parse_a_tree(spark, tmp_path):
    for path, text in {"src/a.py": PY, "src/b.ts": TS, "node_modules/x.ts": TS, "src/.hidden.py": PY, "bad.py": "def (", "notes.txt": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = files.scan(spark, str(tmp_path))
    assert {(r["path"], r["module"], r["language"]) for r in found.collect()} == {("src/a.py", "src", "python"), ("src/b.ts", "src", "typescript"), ("bad.py", ".", "python")}
    assert files.include_folders(found) == ["src"]
    records = extract.parse(found)
    assert {r["path"] for r in records.filter("error is not null").collect()} == {"bad.py"}
    rows = extract.callables(records)
    assert rows.filter("qualified_name = 'User.make'").first()["param_signature"] == "n:int,*rest:any,flag:any,**kw:any"
    assert extract.entities(records, "imports").filter(F.col("file") == "src/b.ts").count() == 2
    assert {r["value"] for r in extract.entities(records, "env_vars").collect()} == {"API_KEY", "B", "API_URL", "KEY"}


def test_config_and_manifests(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"exclude": ["gen"], "features": {"a": 1}}')
    c = files.load_config(str(tmp_path / "c.json"), include=["src"], exclude=None, features={"b": 2})
    assert c.exclude == ("gen",) and c.include == ("src",) and c.features == {"a": 1, "b": 2}
    df = spark.createDataFrame(
        [("package.json", '{"dependencies":{"a":"1","b":"2"},"devDependencies":{"a":"3"}}'), ("requirements.txt", "# x\nflask[async] >= 2.0\n\n-r o.txt\nbare\n"), ("pyproject.toml", '[project]\nname="x"\ndependencies = [\n "fastapi>=1", "a"\n]\n')],
        "path string, content string",
    )
    part = lambda n: df.filter(F.col("path") == n)
    js, req, pyp = files.package_json(part("package.json")), files.requirements(part("requirements.txt")), files.pyproject(part("pyproject.toml"))
    assert {(r["name"], r["version"], r["type"]) for r in js.collect()} == {("a", "3", "development"), ("b", "2", "production")}
    assert {(r["name"], r["version"]) for r in req.collect()} == {("flask", ">= 2.0"), ("bare", "*")}
    assert {(r["name"], r["version"]) for r in pyp.collect()} == {("fastapi", ">=1"), ("a", "*")}
    both = {r["name"]: tuple(r) for r in files.merged_dependencies([("package.json", js), ("pyproject.toml", pyp)]).collect()}
    assert both["a"] == ("a", "*", "production", "package.json, pyproject.toml")
