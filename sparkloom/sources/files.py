"""Sources: source trees, manifests, snapshots. All reading goes through Spark's readers."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.expr import content_hash, language_of, module_of

#: Folders looked at when none is named (fixed values).
KNOWN_FOLDERS = ["src", "lib", "app", "pages", "components", "server", "api", "packages", "cmd", "internal", "pkg"]


@dataclass(frozen=True)
class Config:
    """What is scanned and which frameworks are taken as given. Later sources win: defaults, file, arguments."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("node_modules", "dist", "build", ".git", "vendor", "venv", "__pycache__", "target")
    force_frameworks: tuple[str, ...] = ()
    rules: tuple = ()
    features: dict = field(default_factory=dict)

    def merged(self, *sources: dict) -> Config:
        """With the values of each source in turn; `features` merge one level deep, others are replaced."""
        out = self
        for source in sources:
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in source.items() if k in self.__dataclass_fields__}
            if "features" in known:
                known["features"] = out.features | known["features"]
            out = replace(out, **known)
        return out


def load_config(path: str | None = None, **arguments) -> Config:
    """Defaults, then the JSON file if there is one, then arguments that are not None."""
    stored = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    return Config().merged(stored, {k: v for k, v in arguments.items() if v is not None})


def exclusion_pattern(names: tuple[str, ...]) -> str:
    """A pattern for relative paths: bare names exclude folders anywhere, globs what they match."""
    parts = []
    for name in names:
        if "*" in name or "/" in name:
            glob = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*/|\*\*|\*)", name))
            parts.append(f"(?:^|/){glob}$")
        else:
            parts.append(f"(?:^|/){re.escape(name)}/")
    return "|".join(f"(?:{p})" for p in parts)


def scan(spark: SparkSession, root: str, config: Config | None = None, project: str = "default") -> DataFrame:
    """(project, path, module, language, content, content_hash, size_bytes, mtime, seq): files of known languages, by path.

    Hidden files are left out. `seq` is the path itself: a total order that needs no global numbering."""
    config = config or Config()
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace("path", r"^.*?" + re.escape(re.sub(r"^\w+:/*", "/", base)) + "/", "")
    rows = raw.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), "content")
    rows = rows.filter(~F.col("path").rlike(r"(^|/)\."))
    if config.exclude:
        rows = rows.filter(~F.col("path").rlike(exclusion_pattern(config.exclude)))
    if config.include and "." not in config.include:
        rows = rows.filter(F.col("path").rlike("|".join(f"(?:^{re.escape(d.strip('/'))}/)" for d in config.include)))
    rows = rows.withColumn("language", language_of(F.col("path"))).filter("language is not null")
    text = F.decode("content", "UTF-8")
    return rows.select(F.lit(project).alias("project"), "path", module_of(F.col("path")).alias("module"), "language", text.alias("content"), content_hash(F.col("content")).alias("content_hash"), "size_bytes", "mtime", F.col("path").alias("seq"))


def include_folders(files: DataFrame) -> list[str]:
    """The known top folders that have source files, or `.` when only the root has some."""
    tops = {r[0] for r in files.select(F.substring_index("path", "/", 1)).filter(F.col("path").contains("/")).distinct().collect()}
    return [d for d in KNOWN_FOLDERS if d in tops] or ["."]


def package_json(files: DataFrame) -> DataFrame:
    """(path, name, version, type): dependencies, where peers win over development, and that over production."""
    parsed = F.from_json("content", "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>")
    each = []
    for k, (key, kind) in enumerate((("dependencies", "production"), ("devDependencies", "development"), ("peerDependencies", "peer"))):
        each.append(files.select("path", F.explode(parsed[key]).alias("name", "version"), F.lit(kind).alias("type"), F.lit(k).alias("rank")))
    every = each[0].unionByName(each[1]).unionByName(each[2])
    return every.groupBy("path", "name").agg(F.max_by(F.struct("version", "type"), "rank").alias("x")).select("path", "name", "x.version", "x.type")


def requirements(files: DataFrame, kind: str = "production") -> DataFrame:
    """(path, name, version, type) of requirements files: comments, options and blank lines are skipped; `*` without a version."""
    lines = files.select("path", F.explode(F.split("content", r"\r?\n")).alias("line")).select("path", F.trim("line").alias("line"))
    lines = lines.filter(~F.col("line").rlike(r"^(#|-|$)"))
    pattern = r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*([<>=!~].*)?$"
    rows = lines.select("path", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"))
    return rows.filter("name <> ''").select("path", "name", F.when(F.col("version") == "", "*").otherwise(F.trim("version")).alias("version"), F.lit(kind).alias("type"))


def pyproject(files: DataFrame) -> DataFrame:
    """(path, name, version, type) of the `dependencies` list of `[project]`."""
    block = F.regexp_extract("content", r"(?s)\[project\].*?\ndependencies\s*=\s*\[(.*?)\]\s*\n", 1)
    items = F.regexp_extract_all(block, F.lit(r"[\"']([^\"']+)[\"']"), 1)
    rows = files.select("path", F.explode(items).alias("item"))
    pattern = r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(.*)$"
    version = F.trim(F.regexp_extract("item", pattern, 2))
    return rows.select("path", F.regexp_extract("item", pattern, 1).alias("name"), F.when(version == "", "*").otherwise(version).alias("version"), F.lit("production").alias("type"))


def merged_dependencies(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(name, version, type, sources): later sources win; the names of all sources are listed."""
    every = None
    for k, (label, df) in enumerate(sources):
        part = df.select("name", "version", "type", F.lit(k).alias("rank"), F.lit(label).alias("source"))
        every = part if every is None else every.unionByName(part)
    labels = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "source"))), lambda x: x["source"]), ", ")
    return every.groupBy("name").agg(F.max_by(F.struct("version", "type"), "rank").alias("x"), labels.alias("sources")).select("name", "x.version", "x.type", "sources")
