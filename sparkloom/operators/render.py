"""Text of results: Markdown pages for modules and the root, compact lines, the usage summary.

Lines are column expressions and pages are ordered aggregates of lines, so a page of any module is written by the
task that holds the module's lines; only the root page, one line for each module, is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.expr import half_up, human_bytes


def joined(lines: Column, order: Column, sep: str = "\n") -> Column:
    """An aggregate: lines in the order of `order`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), lines.alias("l")))), lambda x: x["l"]), sep)


def first_of(names: Column, most: int = 20, shown: int = 15) -> Column:
    """`a, b, c`, or the first `shown` and `... +k more` of more than `most`."""
    cut = F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.format_string(" ... +%d more", F.size(names) - shown))
    return F.when(F.size(names) <= most, F.array_join(names, ", ")).otherwise(cut)


def params_text(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.when((p["type"] == "any") | (p["type"] == "") | p["type"].isNull(), p["name"]).otherwise(F.concat(p["name"], F.lit(":"), p["type"]))), ",")


def common_folder(paths: DataFrame) -> DataFrame:
    """One row, `prefix`: the longest folder that all paths share (that of the smallest and the largest path)."""
    ends = paths.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    parts = lambda c: F.split(F.regexp_replace(c, "[^/]*$", ""), "/")
    same = F.zip_with(parts("a"), parts("b"), lambda x, y: x.eqNullSafe(y) & x.isNotNull() & (x != ""))
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))["n"]
    return ends.select(F.when(n > 0, F.concat(F.array_join(F.slice(parts("a"), 1, n), "/"), F.lit("/"))).otherwise("").alias("prefix"))


def callable_line(detail: str = "full") -> Column:
    """A compact line for a callable: `fn name(a:t)→r @file exp cx:3 ln:9`, by level of detail (summary, signature, full)."""
    name = F.when(F.col("class_name").isNull(), F.concat(F.lit("fn "), "name")).otherwise(F.concat(F.lit("."), "name"))
    signature = F.concat(F.lit("("), params_text(F.col("params")), F.lit(")"), F.when(F.col("return_type") != "", F.concat(F.lit("→"), "return_type")).otherwise(""))
    place = F.concat(F.lit(" @"), "file", F.when(F.col("class_name").isNull() & F.col("exported"), " exp").otherwise(""))
    size = F.concat(F.lit(" cx:"), F.col("complexity").cast("string"), F.lit(" ln:"), F.col("line_count").cast("string"))
    return {"summary": F.concat(name, place), "signature": F.concat(name, signature, place), "full": F.concat(name, signature, place, size)}[detail]


def module_pages(callables: DataFrame) -> DataFrame:
    """(module, page): a Markdown page for each module. `callables`: module, file, qualified_name, complexity, line_count, exported."""
    line = F.concat(F.lit("- `"), "qualified_name", F.lit("` ("), F.col("complexity").cast("string"), F.lit(", "), F.col("line_count").cast("string"), F.lit(" lines)"), F.when(F.col("exported"), " exported").otherwise(""))
    files = callables.groupBy("module", "file").agg(F.concat(F.lit("## "), "file", F.lit("\n"), joined(line, F.struct("qualified_name", "seq"))).alias("part"))
    return files.groupBy("module").agg(F.concat(F.lit("# "), "module", F.lit("\n\n"), joined(F.col("part"), F.col("file"), "\n\n")).alias("page"))


def module_lines(stats: DataFrame) -> DataFrame:
    """(module, line): `dir/ (3f, 1c, 4fn, 2t)`. `stats`: module, files, classes, functions, types."""
    part = lambda c, unit: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(unit)))
    counts = F.concat_ws(", ", F.concat(F.col("files").cast("string"), F.lit("f")), part("classes", "c"), part("functions", "fn"), part("types", "t"))
    return stats.select("module", F.concat("module", F.lit("/ ("), counts, F.lit(")")).alias("line"))


def root_page(title: str, stats: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """One row, `page`: a header, the modules, and the health line if there is one."""
    modules = module_lines(stats).agg(joined(F.col("line"), F.col("module")).alias("modules"))
    head = F.concat(F.lit(f"# {title}\n\n## MODULES\n"), F.coalesce("modules", F.lit("")))
    if health is None:
        return modules.select(head.alias("page"))
    score = F.format_string("\n\n## HEALTH\nscore: %d, functions: %d, dead: %d", "score", "total_functions", "dead")
    return modules.join(health.select("score", "total_functions", "dead")).select(F.concat(head, score).alias("page"))


def table(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """One row, `page`: a Markdown table of the columns."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    return rows.agg(F.concat(F.lit(head + "\n"), F.coalesce(joined(line, order), F.lit(""))).alias("page"))


def usage_summary(by_tool: DataFrame) -> DataFrame:
    """One row, `page`: totals and the table of tools, most used first. `by_tool`: as `usage.by_tool` gives it."""
    totals = by_tool.agg(F.sum("calls").alias("c"), F.sum("errors").alias("e"))
    shown = by_tool.select("tool", "calls", "errors", "avg_latency", human_bytes(F.col("total_bytes")).alias("bytes"))
    body = table(shown, ["tool", "calls", "errors", "avg_latency", "bytes"], F.struct(-F.col("calls"), F.col("tool")))
    return totals.join(body).select(F.concat(F.format_string("# Usage\n\ncalls: %d, errors: %d, error rate: %s %%\n\n", "c", "e", half_up(F.col("e") * 100.0 / F.col("c"), 1).cast("string")), "page").alias("page"))
