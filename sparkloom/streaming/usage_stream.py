"""Metering as a stream: the same aggregates as in batch, kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators.usage import bucketed


def bucket_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls and errors for each tool and 5-hour bucket of the day, for a streaming `usage_events`.

    Buckets follow the calendar, so the last of a day has four hours, which no event-time window gives; events
    later than `late` are dropped and their state goes. Use `update` or `complete` output."""
    stamped = events.withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late)
    day = F.window("started_at", "1 day")
    counts = bucketed(stamped).groupBy(day.alias("day"), "bucket", "bucket_end", "tool").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))
    return counts.drop("day")


def flush(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each finished micro-batch as Parquet; a restart goes on from the checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
