"""Recommendations from dead code, duplicates, cycles and hotspots, as rows with a plan of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIORITIES = ("critical", "high", "medium", "low")
BATCH, SHORTEST, SINGLES = 3, 5, 15
CAPS = {"complexity": 10, "god_class": 5, "coupling": 5, "duplicates": 15}

#: Concern of a call by the first pattern that it fits (fixed patterns); else core.
CONCERNS = [
    ("data-transform", r"\.(push|pop|shift|unshift|splice|concat|flat|map|filter|reduce|forEach|find|some|every|sort)\b"),
    ("logging", r"(?i)\b(log|warn|error|info|debug|success|start)\b"),
    ("file-io", r"(?i)\b(read|write|exist|mkdir|unlink|stat|readFile|writeFile)\b"),
    ("parsing", r"(?i)\b(parse|JSON\.|stringify|encode|decode)\b"),
    ("validation", r"\b(valid|check|assert|verify|is[A-Z]|has[A-Z])\b"),
    ("formatting", r"(?i)\b(format|render|generate|template|toString)\b"),
    ("data-access", r"(?i)\b(fetch|request|get|post|put|delete|query|connect)\b"),
    ("configuration", r"(?i)\b(config|option|setting|env)\b"),
]
HELPERS = {
    "data-transform": "transformData", "logging": "logProgress", "file-io": "handleFileIO", "parsing": "parseInput", "validation": "validateInput",
    "formatting": "formatOutput", "data-access": "fetchData", "configuration": "loadConfig", "core": "processCore",
}


def concern(call: Column) -> Column:
    out = F.lit("core")
    for name, pattern in reversed(CONCERNS):
        fits = call.rlike(pattern)
        out = F.when(fits & ~call.rlike(r"^(Map|Set|Array)\.") if name == "data-access" else fits, name).otherwise(out)
    return out


def concern_groups(callables: DataFrame) -> DataFrame:
    """(qualified_name, concern, calls, helper): two or more calls of a callable that share a concern, with a name for a helper."""
    each = callables.select("qualified_name", F.posexplode("calls").alias("pos", "call")).withColumn("concern", concern(F.col("call")))
    rows = each.groupBy("qualified_name", "concern").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "call"))), lambda x: x["call"]).alias("calls")).filter(F.size("calls") >= 2)
    base = F.element_at(F.split("qualified_name", r"\."), -1)
    suffix = F.element_at(F.create_map(*[F.lit(x) for p in HELPERS.items() for x in p]), F.col("concern"))
    return rows.withColumn("helper", F.when(F.length(base) > 20, suffix).otherwise(F.concat(base, F.lit("_"), suffix)))


def dead_priority(lines: Column, exported: Column) -> Column:
    return F.when(lines > 50, "critical").when(lines > 20, "high").when((lines > 10) | exported, "medium").otherwise("low")


def dead_effort(lines: Column, exported: Column) -> Column:
    return F.when(exported, "medium").when(lines > 30, "small").otherwise("trivial")


def _row(category: str, id_: Column, priority: Column, effort: Column, title: Column, files: Column, plan: list[Column]) -> list[Column]:
    return [
        F.lit(category).alias("category"), F.concat(F.lit(f"{category}-"), F.regexp_replace(id_, r"[^a-zA-Z0-9]", "-")).alias("id"), priority.alias("priority"), effort.alias("effort"),
        title.alias("title"), files.alias("files"), F.array_compact(F.array(*plan)).alias("plan"),
    ]


def dead_code(dead: DataFrame) -> DataFrame:
    """A recommendation for each file with three dead callables or more, and for the longest of the others."""
    files = dead.groupBy("file").agg(F.count("*").alias("n"), F.sum("line_count").alias("lines"), F.array_sort(F.collect_list("qualified_name")).alias("names"), F.max("is_exported").alias("any_exported"))
    many = files.filter(F.col("n") >= BATCH)
    priority = F.when(F.col("lines") > 100, "critical").when(F.col("lines") > 40, "high").otherwise("medium")
    check = lambda exported: F.when(exported, "Check that exported ones are not used from outside")
    batch = many.select(*_row(
        "dead-code", F.col("file"), priority, F.when(F.col("any_exported"), "medium").otherwise("small"), F.format_string("Remove %d dead functions from %s (%d lines)", "n", "file", "lines"), F.array("file"),
        [F.concat(F.lit("Find "), F.array_join("names", ", ")), check(F.col("any_exported")), F.lit("Remove them with imports and types that only they use"), F.lit("Run the tests")],
    ))
    rest = dead.filter(F.col("line_count") >= SHORTEST).join(many.select("file"), "file", "left_anti").orderBy(F.desc("line_count"), "seq").limit(SINGLES)
    single = rest.select(*_row(
        "dead-code", F.concat("file", F.lit("-"), "qualified_name"), dead_priority(F.col("line_count"), F.col("is_exported")), dead_effort(F.col("line_count"), F.col("is_exported")),
        F.format_string("Remove dead function %s (%d lines)", "qualified_name", "line_count"), F.array("file"), [check(F.col("is_exported")), F.lit("Remove it with imports that only it uses"), F.lit("Run the tests")],
    ))
    return batch.unionByName(single)


def duplicates(groups: DataFrame) -> DataFrame:
    """For groups of same-named callables: base, members, files, max_similarity; the most alike first."""
    top = groups.orderBy(F.desc("max_similarity"), "base").limit(CAPS["duplicates"])
    alike = F.col("max_similarity") >= 0.7
    priority = F.when((F.col("max_similarity") >= 0.8) & (F.col("members") >= 3), "high").when(alike, "medium").otherwise("low")
    plan = [F.when(alike, "Keep one implementation in a shared module").otherwise("Compare the implementations and keep what they share"), F.lit("Replace the copies by imports"), F.lit("Run the tests")]
    return top.select(*_row("duplicate", F.col("base"), priority, F.when(F.col("members") > 3, "medium").otherwise("small"), F.format_string("Merge %d copies of %s", "members", "base"), F.array().cast("array<string>"), plan))


def cycles(components: DataFrame, cuts: DataFrame) -> DataFrame:
    """For import cycles: the cut that opens each one. `components`: node, component. `cuts`: component, src, dst, weight."""
    members = components.groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node")).alias("files"))
    rows = members.join(cuts, "component")
    priority = F.when(F.col("n") > 5, "critical").when(F.col("n") > 3, "high").otherwise("medium")
    plan = [F.concat(F.lit("Cut the import of "), "dst", F.lit(" in "), "src"), F.lit("Move what both need into a module of its own"), F.lit("Run the tests")]
    return rows.select(*_row("cycle", F.substring(F.array_join("files", "-"), 1, 60), priority, F.when(F.col("weight") > 3, "medium").otherwise("small"), F.format_string("Open a cycle of %d files", "n"), F.col("files"), plan))


def hotspots(rows: DataFrame) -> DataFrame:
    """For hotspots (type, target, file, value, threshold, severity), the largest of each kind."""
    ratio = F.col("value") / F.col("threshold")
    kind = F.when(F.col("type") == "god_class", "god_class").when(F.col("type") == "high_coupling", "coupling").otherwise("complexity")
    order = Window.partitionBy("kind").orderBy(F.desc("value"), "target")
    cap = F.element_at(F.create_map(*[F.lit(x) for p in CAPS.items() for x in p]), F.col("kind"))
    top = rows.withColumn("kind", kind).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap)
    priority = F.when(F.col("severity") == "critical", "high").otherwise("medium")
    plan = [F.when(ratio > 3, "Rewrite it step by step behind tests").otherwise("Split it by concern"), F.lit("Run the tests")]
    return top.select(*_row("hotspot", F.concat("kind", F.lit("-"), "target"), priority, F.when(ratio > 3, "large").otherwise("medium"), F.format_string("Reduce %s (%s %d)", "target", "kind", "value"), F.array("file"), plan))


def report(*parts: DataFrame) -> DataFrame:
    """All recommendations, most urgent first."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.orderBy(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), "category", "id")


def summary(recommendations: DataFrame, dead_lines: int | Column = 0) -> DataFrame:
    """One row: recommendations by priority, and the lines that removing dead code saves."""
    lines = F.lit(dead_lines) if isinstance(dead_lines, int) else dead_lines
    return recommendations.agg(F.count("*").alias("total"), *[F.count_if(F.col("priority") == p).alias(p) for p in PRIORITIES]).withColumn("estimated_lines_saved", lines)
