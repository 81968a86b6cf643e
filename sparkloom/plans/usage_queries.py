"""Metering and history over `events`: a tool is an event type, a session a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.expr import half_up
from sparkloom.operators import history, usage
from sparkloom.plans.registry import query
from sparkloom.session import table

TOOLS = ["click", "error", "purchase", "signup", "view"]
STAMP, STAMP_SQL = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("started_at"), F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").alias("is_error"), F.octet_length("props").cast("long").alias("response_bytes"), F.from_json("props", "map<string,string>").alias("params"), F.col("event_id").alias("seq"),
    )


def daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot a day: score from the share of errors, metrics from the day's counts."""
    e = table(spark, sf_dir, "events")
    counts = [F.count_if(F.col("event_type") == t).alias(t) for t in TOOLS]
    by_day = e.groupBy(F.to_date("ts").alias("ts")).agg(F.count("*").alias("n"), *counts, F.count_distinct("user_id").alias("total_functions"))
    return by_day.withColumn("score", half_up(F.lit(100.0) - F.col("error") * 100.0 / F.col("n")).cast("long"))


EVENTS = """events_ AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS tool, ts, value AS latency_ms, event_type = 'error' AS is_error,
         CAST(strlen(props) AS BIGINT) AS bytes, props, event_id,
         date_trunc('day', ts) + INTERVAL 1 HOUR * CAST(floor(hour(ts) / 5) * 5 AS BIGINT) AS bucket
  FROM events)"""
HISTORY = """history AS (
  SELECT *, CAST(floor(100.0::DOUBLE - error * 100.0::DOUBLE / n + 0.5) AS BIGINT) AS score FROM (
    SELECT CAST(ts AS DATE) AS ts, count(*) AS n, %s, count(DISTINCT user_id) AS total_functions FROM events GROUP BY 1))""" % ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TOOLS)


@query(f"""WITH {EVENTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts, event_id) AS n FROM events_)
SELECT tool, count(*) AS calls, CAST(floor(sum(latency_ms) / count(*) + 0.5) AS BIGINT) AS avg_latency, min(latency_ms) AS min_latency, max(latency_ms) AS max_latency,
       count(*) FILTER (is_error) AS errors, strftime(min(ts), '{STAMP_SQL}') AS first_call, strftime(max(ts), '{STAMP_SQL}') AS last_call,
       CAST(coalesce(sum(bytes) FILTER (bytes > 0), 0) AS BIGINT) AS total_bytes, coalesce(min(bytes) FILTER (bytes > 0), 0) AS min_bytes, coalesce(max(bytes) FILTER (bytes > 0), 0) AS max_bytes,
       CAST(coalesce(floor((sum(bytes) FILTER (bytes > 0))::DOUBLE / max(n) FILTER (bytes > 0) + 0.5), 0) AS BIGINT) AS avg_bytes
FROM numbered GROUP BY tool""")
def usage_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [F.date_format(c, STAMP).alias(c) for c in ("first_call", "last_call")]
    got = usage.by_tool(usage_events(spark, sf_dir))
    return got.select("tool", "calls", "avg_latency", "min_latency", "max_latency", "errors", *shown, "total_bytes", "min_bytes", "max_bytes", "avg_bytes")


@query(f"""WITH {EVENTS}, each_ AS (SELECT tool, unnest(json_keys(props)) AS param, props FROM events_),
valued AS (SELECT tool, param, json_extract_string(props, '$.' || param) AS value FROM each_),
counts AS (SELECT tool, param, value, count(*) AS n FROM valued WHERE length(value) < 200 GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tool, param ORDER BY n DESC, value) AS INTEGER) AS rank FROM counts) WHERE rank <= 5""")
def usage_params_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.parameter_values(usage_events(spark, sf_dir))


@query(f"""WITH {EVENTS} SELECT strftime(bucket, '{STAMP_SQL}') AS bucket, tool, count(*) AS calls, count(*) FILTER (is_error) AS errors,
strftime(least(bucket + INTERVAL 5 HOUR, date_trunc('day', bucket) + INTERVAL 1 DAY), '{STAMP_SQL}') AS bucket_end FROM events_ GROUP BY ALL""")
def usage_5h_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [F.date_format(c, STAMP).alias(c) for c in ("bucket", "bucket_end")]
    return usage.buckets(usage_events(spark, sf_dir), "tool").select(*shown, "tool", "calls", "errors")


@query(f"""WITH {EVENTS}, counts AS (SELECT CAST(ts AS DATE) AS day, tool, count(*) AS n, count(*) FILTER (is_error) AS e FROM events_ GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, tool) AS r FROM counts)
SELECT CAST(day AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(e) AS BIGINT) AS errors, string_agg(tool || ':' || n, ', ' ORDER BY r) FILTER (r <= 3) AS top_tools FROM ranked GROUP BY day""")
def usage_daily_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily(usage_events(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {EVENTS} SELECT strftime(bucket, '{STAMP_SQL}') AS bucket, {", ".join(f"count(*) FILTER (tool = '{t}') AS {t}" for t in TOOLS)} FROM events_ GROUP BY events_.bucket ORDER BY events_.bucket DESC LIMIT 20""")
def usage_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.heatmap(usage_events(spark, sf_dir), TOOLS).withColumn("bucket", F.date_format("bucket", STAMP))


@query("""WITH c AS (SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY 1),
s AS (SELECT tool, calls, floor(calls * 100.0::DOUBLE / sum(calls) OVER () * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS share FROM c)
SELECT tool, calls, share, repeat('#', CAST(floor(share / 5) AS BIGINT)) AS bar FROM s""")
def usage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.shares(usage_events(spark, sf_dir))


@query(f"""WITH {EVENTS}, c AS (SELECT session_id, tool, count(*) AS n, count(*) FILTER (is_error) AS e, min(ts) AS a, max(ts) AS z FROM events_ GROUP BY ALL)
SELECT session_id, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(e) AS BIGINT) AS errors, strftime(min(a), '{STAMP_SQL}') AS started, strftime(max(z), '{STAMP_SQL}') AS ended,
first(tool ORDER BY n DESC, tool) AS top_tool FROM c GROUP BY session_id""")
def usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [F.date_format(c, STAMP).alias(c) for c in ("started", "ended")]
    return usage.sessions(usage_events(spark, sf_dir)).select("session_id", "calls", "errors", *shown, "top_tool")


@query(f"""WITH {EVENTS}, c AS (SELECT session_id, count(*) AS calls, min(ts) AS started FROM events_ GROUP BY 1)
SELECT session_id, calls, strftime(started, '{STAMP_SQL}') AS started FROM (SELECT * FROM c ORDER BY c.started DESC, session_id DESC LIMIT 10)""")
def usage_last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sessions(usage_events(spark, sf_dir), 10).select("session_id", "calls", F.date_format("started", STAMP).alias("started"))


@query(f"""WITH {EVENTS} SELECT strftime(bucket, '{STAMP_SQL}') AS bucket, count(*) AS calls FROM events_ GROUP BY events_.bucket ORDER BY events_.bucket DESC LIMIT 200""")
def usage_retained_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = usage.retained(usage.buckets(usage_events(spark, sf_dir)), 200, "bucket")
    return kept.select(F.date_format("bucket", STAMP).alias("bucket"), "calls")


@query(f"""WITH {HISTORY}, last AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS r FROM history)
SELECT CAST(a.ts AS VARCHAR) AS ts, a.score AS current, b.score AS previous, a.score - b.score AS delta,
CASE WHEN a.score - b.score > 2 THEN 'improving' WHEN a.score - b.score < -2 THEN 'degrading' ELSE 'stable' END AS direction FROM last a, last b WHERE a.r = 1 AND b.r = 2""")
def health_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trend(daily_history(spark, sf_dir)).withColumn("ts", F.col("ts").cast("string"))


FALLING = "'2024-01-10'"


@query(f"""WITH {HISTORY}, h AS (SELECT ts, CAST(CASE WHEN ts > DATE {FALLING} THEN 1000 - 5 * date_diff('day', DATE {FALLING}, ts) ELSE score END AS BIGINT) AS score FROM history),
l AS (SELECT *, lag(score) OVER (ORDER BY ts) AS before, lead(ts) OVER (ORDER BY ts) AS next FROM h)
SELECT CAST((SELECT max(ts) FROM h) AS VARCHAR) AS ts, CAST(max(ts) AS VARCHAR) AS since FROM l WHERE next IS NOT NULL AND (before IS NULL OR score >= before)
HAVING (SELECT first(score ORDER BY ts DESC) - (SELECT score FROM h ORDER BY ts DESC LIMIT 1 OFFSET 1) FROM h) < -2""")
def degrading_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a history that falls by five points a day after a date, so that there is a row to return."""
    falls = F.lit(1000) - F.datediff("ts", F.lit("2024-01-10").cast("date")) * 5
    falling = daily_history(spark, sf_dir).withColumn("score", F.when(F.col("ts") > F.lit("2024-01-10").cast("date"), falls).otherwise(F.col("score")).cast("long"))
    got = history.degrading_since(falling)
    return got.select(*[F.col(c).cast("string").alias(c) for c in ("ts", "since")])


MOVERS = [*TOOLS, "total_functions"]


@query(f"""WITH {HISTORY}, last AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS r FROM history),
d AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, b.{m}::DOUBLE AS before, a.{m}::DOUBLE AS now FROM last a, last b WHERE a.r = 1 AND b.r = 2" for m in MOVERS)})
SELECT metric, before, now, now - before AS delta, CASE WHEN now > before AND metric <> 'total_functions' THEN 'worse' ELSE 'better' END AS direction FROM d WHERE now <> before""")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.movers(daily_history(spark, sf_dir), MOVERS)


@query(f"""WITH {HISTORY} SELECT CAST(ts AS VARCHAR) AS ts, score FROM (SELECT ts, score FROM history ORDER BY ts DESC LIMIT 100)""")
def history_last_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.retained(daily_history(spark, sf_dir), 100, "ts").select(F.col("ts").cast("string").alias("ts"), "score")
