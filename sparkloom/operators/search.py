"""Ranked and plain search over named entities, and lookups by name or path.

`entities`: kind, name, file, exported, callers, seq (order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.expr import relevance, token_score, tokenize


def ranked(entities: DataFrame, term: str, limit: int | None = 30) -> DataFrame:
    """Entities that match a term, best first: by tokens, else (with half a point) by substring. Blank terms match nothing."""
    if not term.strip():
        return entities.filter("false").withColumn("score", F.lit(0.0))
    query = tokenize(F.lit(term))
    found = entities.withColumn("score", token_score(query, tokenize(F.col("name"))))
    base = F.when(F.col("score") > 0, F.col("score")).when(F.contains(F.lower("name"), F.lit(term.lower())), 0.5)
    scored = found.withColumn("base", base).filter("base is not null")
    scored = scored.withColumn("score", relevance(F.col("base"), F.col("name"), F.col("kind"), F.col("file"), F.col("exported"), F.col("callers"))).drop("base")
    ordered = scored.orderBy(F.desc("score"), "seq")
    return ordered.limit(limit) if limit else ordered


def substring(entities: DataFrame, term: str) -> DataFrame:
    """Entities whose bare name (after the last dot for methods) contains the term, in any case."""
    bare = F.when(F.col("kind") == "method", F.element_at(F.split("name", r"\."), -1)).otherwise(F.col("name"))
    return entities.filter(F.contains(F.lower(bare), F.lit(term.lower())))


def by_name(entities: DataFrame, name: str, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """One entity: the first kind that has the name exactly, or as `Class.name` for methods."""
    exact = F.col("name") == name
    method = (F.col("kind") == "method") & F.col("name").endswith(f".{name}")
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return entities.filter(F.col("kind").isin(*kinds) & (exact | method)).orderBy(order, "seq").limit(1)


def by_path(files: DataFrame, path: str) -> DataFrame:
    """The file of a path, else all whose path contains it."""
    from sparkloom.operators.graph import resolve_file

    return files.join(resolve_file(files, path), "path", "left_semi")


def in_module(files: DataFrame, module: str) -> DataFrame:
    """Files of a directory and of those below it. `files`: path, module."""
    return files.filter((F.col("module") == module) | F.col("module").startswith(f"{module}/"))


def lookup(entities: DataFrame, name: str) -> DataFrame:
    """The cascade function, class, type, file: the rows of the first kind that has the name, else the ranked search."""
    kinds = F.array(*map(F.lit, ("function", "method", "class", "type", "file")))
    hits = entities.filter((F.col("name") == name) | ((F.col("kind") == "method") & F.col("name").endswith(f".{name}"))).withColumn("place", F.array_position(kinds, F.col("kind")))
    best = hits.filter("place > 0").agg(F.min("place").alias("best"))
    exact = hits.join(F.broadcast(best), F.col("place") == F.col("best")).select(*entities.columns, F.lit(0.0).alias("score"))
    none = best.filter("best is null").select(F.lit(True).alias("none"))
    return exact.unionByName(ranked(entities, name).join(F.broadcast(none)).drop("none"))


def module_stats(files: DataFrame, callables: DataFrame, classes: DataFrame, types: DataFrame) -> DataFrame:
    """(module, files, classes, functions, types) for each directory that has a file. All have `module`."""
    counts = [x.groupBy("module").agg(F.count("*").alias(n)) for n, x in (("files", files), ("classes", classes), ("functions", callables), ("types", types))]
    out = counts[0]
    for more in counts[1:]:
        out = out.join(more, "module", "left")
    return out.na.fill(0)


def filter_routes(routes: DataFrame, method: str | None = None, path: str | None = None, framework: str | None = None) -> DataFrame:
    """Routes by method (`ALL` fits any), part of the path in any case, and framework. `routes`: methods ARRAY, path, framework."""
    out = routes
    if method:
        out = out.filter(F.exists("methods", lambda m: (F.upper(m) == method.upper()) | (F.upper(m) == "ALL")))
    if path:
        out = out.filter(F.contains(F.lower("path"), F.lit(path.lower())))
    return out.filter(F.col("framework") == framework) if framework else out


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified files. Both: path, hash."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def stale(files: DataFrame, since, limit: int | None = None) -> DataFrame:
    """Files changed after a snapshot's time, in order. `files`: path, mtime."""
    out = files.filter(F.col("mtime") > F.lit(since)).orderBy("path")
    return out.limit(limit) if limit else out


def filter_models(models: DataFrame, framework: str | None = None, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Models by framework, kind and part of the name in any case. `models`: name, framework, kind and more."""
    out = models.filter(F.col("framework") == framework) if framework else models
    out = out.filter(F.col("kind") == kind) if kind else out
    return out.filter(F.contains(F.lower("name"), F.lit(name.lower()))) if name else out


def filter_middleware(middleware: DataFrame, framework: str | None = None) -> DataFrame:
    return middleware.filter(F.col("framework") == framework) if framework else middleware


def clustered(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(rank, name, root, size): three results or fewer stand alone, more are grouped by who calls whom."""
    from sparkloom.operators.graph import search_clusters

    if results.limit(4).count() <= 3:
        return results.select("rank", "name", F.col("name").alias("root"), F.lit(1).cast("long").alias("size"))
    return search_clusters(results, edges)


def dependencies_by_type(dependencies: DataFrame) -> DataFrame:
    """(type, n, packages): packages of each type, `name@version` in order. `dependencies`: package, version, type."""
    named = F.concat_ws("@", "package", "version")
    return dependencies.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(named)), ", ").alias("packages"))


def modules_in_scope(coupling: DataFrame, scope: str | None = None, most: int = 10) -> DataFrame:
    """The modules under a path, or the `most` unstable ones. `coupling`: module, instability and more."""
    if scope:
        return coupling.filter((F.col("module") == scope) | F.col("module").startswith(scope.rstrip("/") + "/"))
    return coupling.orderBy(F.desc("instability"), "module").limit(most)
