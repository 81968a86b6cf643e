"""Trend of health snapshots: direction, since when it degrades, what moved most.

`history`: ts, score and any metric columns, one row for each snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trend(history: DataFrame) -> DataFrame:
    """The last snapshot against the one before; no row with fewer than two."""
    pair = history.orderBy(F.desc("ts")).limit(2).agg(F.max_by("score", "ts").alias("current"), F.min_by("score", "ts").alias("previous"), F.max("ts").alias("ts"), F.count("*").alias("n"))
    delta = F.col("current") - F.col("previous")
    direction = F.when(delta > 2, "improving").when(delta < -2, "degrading").otherwise("stable")
    return pair.filter("n = 2").select("ts", "current", "previous", delta.alias("delta"), direction.alias("direction"))


def degrading_since(history: DataFrame) -> DataFrame:
    """If the trend degrades: the latest snapshot before the last that did not fall below the one before it."""
    rows = history.select("ts", "score")
    many, order = 128, Window.orderBy("ts")
    while True:
        # Backwards from the end in growing steps: the window only ever sees the last `many` snapshots.
        last = rows.orderBy(F.desc("ts")).limit(many + 1)
        some = last.select("ts", F.col("score"), F.lag("score").over(order).alias("before"), F.lead("ts").over(order).alias("next"))
        rose = some.filter("next is not null and score >= before").agg(F.max("ts").alias("since"), F.min("ts").alias("first"))
        if rose.first()["since"] is not None or last.count() <= many:
            break
        many *= 8
    first = rows.agg(F.min("ts").alias("first_ts"))
    rose = rose.crossJoin(first).select(F.coalesce("since", "first_ts").alias("since"))
    return trend(history).filter("direction = 'degrading'").crossJoin(rose).select("ts", "since")


def movers(history: DataFrame, metrics: list[str], neutral: tuple[str, ...] = ("total_functions",)) -> DataFrame:
    """Metrics that changed between the last two snapshots, largest change first; more is worse but for `neutral` ones."""
    last = history.orderBy(F.desc("ts")).limit(2)
    ends = last.agg(*[F.max_by(m, "ts").alias(f"{m}_now") for m in metrics], *[F.min_by(m, "ts").alias(f"{m}_before") for m in metrics], F.count("*").alias("n")).filter("n = 2")
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(m).alias("metric"), F.col(f"{m}_before").cast("double").alias("before"), F.col(f"{m}_now").cast("double").alias("now")) for k, m in enumerate(metrics)])
    rows = ends.select(F.inline(each)).withColumn("delta", F.col("now") - F.col("before")).filter("delta <> 0")
    worse = (F.col("delta") > 0) & ~F.col("metric").isin(*neutral)
    return rows.withColumn("direction", F.when(worse, "worse").otherwise("better")).orderBy(F.desc(F.abs("delta")), "place").drop("place")
