"""Connected components over edge tables, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest of its neighbourhood."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node, is hung on the smallest."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b: long); the component is its smallest node.

    Self-loops, repeated edges and rows with a null end carry nothing. Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain. A node with very many edges
    is a hot join key, which Spark splits; its minimum is pre-aggregated.
    """
    e = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    sign = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    last = e.agg(sign.alias("s")).first().s
    while last.n:
        e = stored(_small_star(_large_star(e)))
        now = e.agg(sign.alias("s")).first().s
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
