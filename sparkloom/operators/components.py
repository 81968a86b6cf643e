"""Connected components of an undirected graph as a fixpoint of joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Alternates the two star operations of Kiveris et al. (2014): every node hands its neighbours over to the
    smallest node it sees. Each round is two minimum aggregations (partially aggregated before the shuffle)
    and two joins that split when skewed, so a hub costs no task more than its share. The edges shrink
    towards stars in a logarithmic number of rounds; each round cuts its lineage with a checkpoint. The loop
    ends only when a round changes nothing.
    """
    big, small = F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    # u > v throughout; a self-loop stays as (u, u) so that its node keeps a row.
    pairs = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(big, small).distinct())
    nodes = pairs.filter("u = v").select("u")
    pairs = pairs.filter("u > v")
    before = None
    while True:
        # Large star: each node links its larger neighbours to the smallest of itself and its neighbours.
        both = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(pairs.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.select(F.col("v").alias("a"), F.col("u").alias("b")).join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node links itself and its smaller neighbours to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = cut(star)
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    alone = nodes.select(F.col("u").alias("node")).join(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))), "node", "left_anti")
    return found.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))
