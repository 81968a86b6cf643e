"""Rendered text over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import render, usage
from sparkloom.plans import code_queries as code
from sparkloom.plans.registry import query
from sparkloom.plans.usage_queries import EVENTS, usage_events


@query(f"""WITH {code.CALLABLES}, parts AS (SELECT file, '## ' || file || chr(10) || string_agg('- `' || qualified_name || '` (' || complexity || ', ' || line_count || ' lines)' || CASE WHEN exported THEN ' exported' ELSE '' END, chr(10) ORDER BY qualified_name, seq) AS part FROM f GROUP BY file)
SELECT file AS module, '# ' || file || chr(10) || chr(10) || part AS page FROM parts""")
def module_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.module_pages(code.callables(spark, sf_dir).withColumn("module", F.col("file")))


@query(f"WITH {code.ENTITIES}, m AS (SELECT file, count(*) AS n, count(*) FILTER (kind = 'class') AS c, count(*) FILTER (kind = 'method') AS fn, count(*) FILTER (kind = 'type') AS t FROM e GROUP BY file) SELECT file AS module, file || '/ (' || n || 'f' || CASE WHEN c > 0 THEN ', ' || c || 'c' ELSE '' END || CASE WHEN fn > 0 THEN ', ' || fn || 'fn' ELSE '' END || CASE WHEN t > 0 THEN ', ' || t || 't' ELSE '' END || ')' AS line FROM m")
def module_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.module_lines(code.module_stats(spark, sf_dir))


@query(f"""WITH {EVENTS}, t AS (SELECT tool, count(*) AS calls, count(*) FILTER (is_error) AS errors, CAST(floor(sum(latency_ms) / count(*) + 0.5) AS BIGINT) AS avg_latency, CAST(sum(bytes) AS BIGINT) AS bytes FROM events_ GROUP BY tool),
l AS (SELECT *, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f', floor(bytes / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(bytes / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' END AS size FROM t)
SELECT '# Usage' || chr(10) || chr(10) || 'calls: ' || sum(calls) || ', errors: ' || sum(errors) || ', error rate: ' || CAST(floor(sum(errors) * 100.0::DOUBLE / sum(calls) * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS VARCHAR) || ' %' || chr(10) || chr(10)
  || '| tool | calls | errors | avg_latency | bytes |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg('| ' || tool || ' | ' || calls || ' | ' || errors || ' | ' || avg_latency || ' | ' || size || ' |', chr(10) ORDER BY calls DESC, tool) AS page FROM l""")
def usage_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.usage_summary(usage.by_tool(usage_events(spark, sf_dir)))
