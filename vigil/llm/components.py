"""Connected components of an edge table by alternating large-star and small-star steps, all as joins and aggregates.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is written to the shared folder; a
hub never meets in one task: neighbours are aggregated to their minimum before the shuffle, and the join with the minima is
one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage, unstage


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest id that can be reached) of each id in the edges (u, v). Without edges the result is empty."""
    now, old = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u <> v").distinct(), []
    for _ in range(rounds):
        now = stage(_small(_large(now)).distinct(), "star")
        unstage(*old)
        old = [now]
        # done when every node either is a centre or has one; the steps keep what is connected, so the stars are the components
        roles = now.select(F.col("u").alias("n"), F.lit(1).alias("leaf")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("leaf")))
        open_nodes = roles.groupBy("n").agg(F.sum("leaf").alias("centres"), F.min("leaf").alias("least")).where("centres > 1 or (centres = 1 and least = 0)")
        if not open_nodes.limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components not done after {rounds} rounds")
