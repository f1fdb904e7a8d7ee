"""Connected components of a graph given by its edges, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, out: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b), both long, written in ``out``.

    A component is named by its smallest node.  Each round hangs every node
    below the smallest label among its neighbours and then halves the paths
    (large star, small star); the number of rounds grows with the logarithm of
    the diameter.  A hub's edges are combined before they are shuffled.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    try:
        now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        for _ in range(rounds):
            if _settled(now):
                break
            following = Scratch(spark)
            now = _round(now, following)
            scratch.release()
            scratch = following
        else:
            raise RuntimeError("components did not settle")
        stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
        return out.cut(stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    finally:
        scratch.release()


def _round(now: DataFrame, out: Scratch) -> DataFrame:
    with Scratch(now.sparkSession) as scratch:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written first: then a hub's edges can be split in the join
        low = scratch.cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = scratch.cut(large.where("a <> b").distinct())
        # small star: a node and its neighbours below go to the smallest of them
        least = scratch.cut(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        return out.cut(small.union(least.select("a", F.col("low").alias("b"))).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether each node above has one edge and none is also a node below, that is, all components are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)).distinct())
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or ups = 1 and n > 1").isEmpty()
