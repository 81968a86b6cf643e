"""A snapshot of a source tree: canonical tables built once, written as Parquet, queried by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.expr import filter_calls, is_entry_point
from sparkloom.operators import coupling, frameworks, graph, quality, recommend, search
from sparkloom.sources import extract, files


class Snapshot:
    """Tables by name: files, callables, classes, properties, imports, exports, types, env_refs, call_edges, import_edges, reverse."""

    TABLES = ("files", "callables", "classes", "properties", "imports", "exports", "types", "env_refs", "call_edges", "import_edges", "reverse")

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @staticmethod
    def build(spark: SparkSession, root: str, config: files.Config | None = None, project: str = "default", detected: tuple[str, ...] = ()) -> Snapshot:
        """Scan, extract, and derive the graphs. `detected`: frameworks, as found by `frameworks.detect`."""
        config = config or files.Config()
        found = files.scan(spark, root, config, project)
        records = extract.parse(found).cache()
        rows = extract.callables(records).withColumn("calls", filter_calls(F.col("calls")))
        imports = extract.entities(records, "imports")
        module_calls = records.select(F.col("path").alias("file"), filter_calls(F.col("module_calls")).alias("calls"), F.col("path").alias("seq")).filter(F.size("calls") > 0)
        calls = graph.call_edges(rows, module_calls)
        synthetic = frameworks.synthetic_edges(rows, {*detected, *config.force_frameworks}, list(config.rules))
        merged = frameworks.merge_edges(calls, synthetic)
        keys = rows.select(F.col("qualified_name").alias("key")).unionByName(merged.select(F.col("caller").alias("key"))).distinct()
        tables = {name: extract.entities(records, name) for name in ("classes", "properties", "exports", "types")}
        tables |= {
            "files": found.drop("content"), "callables": rows, "imports": imports, "env_refs": extract.entities(records, "env_vars").withColumnRenamed("value", "var"), "call_edges": merged,
            "import_edges": graph.import_edges(found, imports), "reverse": graph.reverse_resolved(merged, keys),
        }
        return Snapshot(tables)

    def write(self, path: str) -> None:
        for name in self.TABLES:
            self.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Snapshot:
        return Snapshot({name: spark.read.parquet(f"{path}/{name}") for name in Snapshot.TABLES})

    def entities(self) -> DataFrame:
        """All that can be searched: kind, name, file, exported, callers, seq."""
        counts = self["reverse"].groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("callers"))
        c = self["callables"].select("kind", F.col("qualified_name").alias("name"), "file", F.when(F.col("kind") == "method", F.col("access") == "public").otherwise(F.col("exported")).alias("exported"), F.concat(F.lit("3"), "seq").alias("seq")).join(counts, "name", "left")
        no = F.lit(0).cast("long")
        f = self["files"].select(F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file"), F.lit(False).alias("exported"), F.concat(F.lit("1"), "seq").alias("seq"), no.alias("callers"))
        k, t = (self[n].select(F.lit(kind).alias("kind"), "name", "file", F.lit(False).alias("exported"), F.concat(F.lit(p), "seq").alias("seq"), no.alias("callers")) for n, kind, p in (("classes", "class", "2"), ("types", "type", "4")))
        return f.unionByName(k).unionByName(c).unionByName(t).withColumn("callers", F.coalesce("callers", no))

    def search(self, term: str, limit: int = 30) -> DataFrame:
        return search.ranked(self.entities(), term, limit)

    def query(self, name: str) -> DataFrame:
        return search.lookup(self.entities(), name)

    def callers(self, name: str) -> DataFrame:
        """Callers by the raw text of their calls."""
        return self["call_edges"].filter(F.col("callee") == name).select("caller").distinct()

    def calls(self, name: str) -> DataFrame:
        return self["call_edges"].filter(F.col("caller") == name).select("callee").distinct()

    def explore(self, name: str, depth: int = 2, direction: str = "both") -> DataFrame:
        return graph.explore(self["call_edges"], name, depth, direction)

    def dependencies(self, path: str) -> DataFrame:
        both = graph.dependencies(self["import_edges"], self["files"])
        return both.join(graph.resolve_file(self["files"], path).withColumnRenamed("path", "file"), "file", "left_semi")

    def overview(self) -> DataFrame:
        return self.entities().groupBy("kind").agg(F.count("*").alias("n"))

    def module(self, name: str) -> DataFrame:
        return search.in_module(self["files"], name)

    def coupling(self) -> DataFrame:
        c = self["callables"].select("file", F.col("qualified_name").alias("name"), "complexity", "seq")
        return coupling.module_coupling(self["files"], self["import_edges"], c).orderBy(F.desc("instability"), "module")

    def dead_code(self) -> DataFrame:
        entries = self["files"].filter(is_entry_point(F.col("path"))).select(F.col("path").alias("file"))
        return quality.dead_functions(self["callables"], self["reverse"], entries, self["exports"])

    def health(self) -> DataFrame:
        return quality.health(self["callables"], self["classes"], self.dead_code())

    def hotspots(self, limit: int = 20) -> DataFrame:
        return quality.hotspots(self["callables"], limit)

    def duplicates(self) -> DataFrame:
        return quality.same_name_groups(self["callables"])

    def cycles(self) -> tuple[DataFrame, DataFrame]:
        """The files of import cycles, and the edge that opens each one best."""
        found = graph.strongly_connected(self["import_edges"])
        inner = graph.cycle_edges(self["import_edges"].select("src", "dst"), found)
        weighed = graph.edge_symbols(inner, self["imports"]).withColumn("symbols", F.size("symbols"))
        return found, graph.minimum_cuts(weighed)

    def cohesion(self) -> DataFrame:
        methods = self["callables"].filter("class_name is not null")
        return graph.cohesion(methods, self["properties"])

    def recommendations(self) -> DataFrame:
        return recommend.report(recommend.dead_code(self.dead_code()), recommend.duplicates(self.duplicates()), recommend.cycles(*self.cycles()), recommend.hotspots(self.hotspots()))

    def diff(self, older: Snapshot) -> DataFrame:
        hashed = lambda s: s["files"].select("path", F.col("content_hash").alias("hash"))
        return search.snapshot_diff(hashed(older), hashed(self))


class Registry:
    """Snapshots of several projects by name; each is read once and again only when its folder is written anew."""

    def __init__(self, spark: SparkSession, projects: dict[str, str]):
        self.spark, self.projects, self.kept = spark, dict(projects), {}

    def resolve(self, name: str | None = None) -> str:
        """The name of the project that is meant: the only one, one of that name, or one whose path ends with it."""
        if name is None:
            if len(self.projects) == 1:
                return next(iter(self.projects))
            raise ValueError(f"name one of {', '.join(sorted(self.projects)) or 'no projects'}")
        hits = [p for p in self.projects if p == name] or [p for p, path in self.projects.items() if path.rstrip("/").endswith(f"/{name}")]
        if len(hits) != 1:
            raise ValueError(f"{'no' if not hits else 'more than one'} project is called {name}")
        return hits[0]

    def snapshot(self, name: str | None = None) -> Snapshot:
        """The snapshot, read again if its files have changed."""
        name = self.resolve(name)
        path = self.projects[name]
        version = tuple(sorted(self.spark.read.parquet(f"{path}/files").inputFiles()))
        if self.kept.get(name, (None,))[0] != version:
            self.kept[name] = version, Snapshot.read(self.spark, path)
        return self.kept[name][1]

    def status(self) -> DataFrame:
        """(project, files, callables, classes) for each project."""
        out = None
        for name in sorted(self.projects):
            s = self.snapshot(name)
            row = s["files"].agg(F.count("*").alias("files")).join(s["callables"].agg(F.count("*").alias("callables"))).join(s["classes"].agg(F.count("*").alias("classes"))).select(F.lit(name).alias("project"), "*")
            out = row if out is None else out.unionByName(row)
        return out if out is not None else self.spark.createDataFrame([], "project string, files long, callables long, classes long")
