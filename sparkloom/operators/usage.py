"""Metering of tool calls: totals, parameters, buckets, days, sessions. One definition for batch and stream.

`usage_events`: session_id, tool, started_at TIMESTAMP, latency_ms, is_error, response_bytes, params MAP.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.expr import bucket_end, bucket_start, half_up

MAX_VALUE = 200


def bucketed(events: DataFrame) -> DataFrame:
    return events.withColumn("bucket", bucket_start(F.col("started_at"))).withColumn("bucket_end", bucket_end(F.col("started_at")))


def tool_totals() -> list[Column]:
    """Aggregates for any grouping of events, batch or streaming."""
    sized = F.when(F.col("response_bytes") > 0, F.col("response_bytes"))
    return [
        F.count("*").alias("calls"),
        F.sum("latency_ms").alias("total_latency"),
        half_up(F.sum("latency_ms") / F.count("*")).cast("long").alias("avg_latency"),
        F.min("latency_ms").alias("min_latency"),
        F.max("latency_ms").alias("max_latency"),
        F.count_if("is_error").alias("errors"),
        F.min("started_at").alias("first_call"),
        F.max("started_at").alias("last_call"),
        F.coalesce(F.sum(sized), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.min(sized), F.lit(0)).alias("min_bytes"),
        F.coalesce(F.max(sized), F.lit(0)).alias("max_bytes"),
    ]


def by_tool(events: DataFrame) -> DataFrame:
    """Totals for each tool. The average size divides by the calls made up to the last one with a size, as a
    running average does that later calls without a size leave alone.

    Two partial aggregations and a join with one row a tool (broadcast if Spark finds it small), no sort by time."""
    at = F.struct("started_at", "seq")
    last = events.filter("response_bytes > 0").groupBy("tool").agg(F.max(at).alias("last"))
    totals = events.join(last, "tool", "left").groupBy("tool").agg(*tool_totals(), F.count_if(at <= F.col("last")).alias("divisor"))
    return totals.withColumn("avg_bytes", F.when(F.col("divisor") > 0, half_up(F.col("total_bytes") / F.col("divisor")).cast("long")).otherwise(0)).drop("divisor")


def parameter_values(events: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent values of each parameter of each tool (strings shorter than 200)."""
    each = events.select("tool", F.explode("params").alias("param", "value")).filter(F.length("value") < MAX_VALUE)
    counts = each.groupBy("tool", "param", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("tool", "param").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def buckets(events: DataFrame, *more: str) -> DataFrame:
    """Calls and errors for each 5-hour bucket of the day (and each of `more`)."""
    return bucketed(events).groupBy("bucket", "bucket_end", *more).agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))


def daily(events: DataFrame, top: int = 3) -> DataFrame:
    """Each day's calls, errors and most used tools."""
    counts = events.groupBy(F.to_date("started_at").alias("day"), "tool").agg(F.count("*").alias("n"), F.count_if("is_error").alias("e"))
    order = Window.partitionBy("day").orderBy(F.desc("n"), "tool")
    ranked = counts.withColumn("r", F.row_number().over(order))
    shown = F.when(F.col("r") <= top, F.struct("r", F.concat_ws(":", "tool", F.col("n").cast("string")).alias("t")))
    best = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), ", ")
    return ranked.groupBy("day").agg(F.sum("n").alias("calls"), F.sum("e").alias("errors"), best.alias("top_tools"))


def heatmap(events: DataFrame, tools: list[str], last: int = 20) -> DataFrame:
    """Calls of each tool (a column each) in the last buckets."""
    cells = bucketed(events).groupBy("bucket").pivot("tool", tools).agg(F.count(F.lit(1))).na.fill(0)
    return cells.orderBy(F.desc("bucket")).limit(last)


def shares(events: DataFrame) -> DataFrame:
    """Each tool's share of all calls in percent, with a bar of one mark for every five percent."""
    counts = events.groupBy("tool").agg(F.count("*").alias("calls"))
    whole = counts.agg(F.sum("calls").alias("all_calls"))
    share = half_up(F.col("calls") * F.lit(100.0) / F.col("all_calls"), 1)
    return counts.join(F.broadcast(whole)).select("tool", "calls", share.alias("share"), F.repeat(F.lit("#"), F.floor(share / 5).cast("int")).alias("bar"))


def sessions(events: DataFrame, last: int | None = None) -> DataFrame:
    """Each session's calls, errors, times and most used tool; the latest `last` of them."""
    counts = events.groupBy("session_id", "tool").agg(F.count("*").alias("n"), F.count_if("is_error").alias("e"), F.min("started_at").alias("a"), F.max("started_at").alias("z"))
    out = counts.groupBy("session_id").agg(
        F.sum("n").alias("calls"), F.sum("e").alias("errors"), F.min("a").alias("started"), F.max("z").alias("ended"), F.min_by("tool", F.struct(-F.col("n"), F.col("tool"))).alias("top_tool")
    )
    return out.orderBy(F.desc("started"), F.desc("session_id")).limit(last) if last else out


def retained(rows: DataFrame, keep: int, by: str, *ties: str) -> DataFrame:
    """The newest `keep` rows of an append-only table."""
    return rows.orderBy(F.desc(by), *map(F.desc, ties)).limit(keep)
