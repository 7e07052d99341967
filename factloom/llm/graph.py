"""Connected components of an edge list, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (u, v).

    Each round hangs what is larger than a node under the smallest of its neighbours, then the
    node's smaller neighbours too, until nothing changes; that takes a number of rounds that grows
    with the logarithm of the longest path. A hub's edges are joined, never collected. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    now = durable(
        edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct()
    )  # u > v

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        ).where("u <> v").distinct()
        now = durable(small)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
