"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import saved


def _large_star(edges: DataFrame, salts: int = 64) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood.

    A node may have any number of neighbours: they are summed up in salted parts, and meet their node's least through these.
    """
    both = edges.union(edges.select("v", "u")).toDF("u", "v").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    parts = both.groupBy("u", "salt").agg(F.min("v").alias("least"))
    least = parts.groupBy("u").agg(F.least(F.col("u"), F.min("least")).alias("m"))
    named = parts.select("u", "salt").join(least, "u")
    return both.where("v > u").join(named, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return tied.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, label`` for the nodes of ``edges(u, v)``; the label is the smallest node reachable.

    Each round's edges are written to the shared folder.  The rounds end when the edges are stars (each node has one
    edge, to a root that has none upward); a star's centre is the smallest node of its component.
    """
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        roots = edges.select(F.col("v").alias("u")).distinct()
        # stars: no centre is itself tied to a smaller node, and no node is tied twice
        if edges.join(roots, "u", "left_semi").limit(1).count() == 0 and edges.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
        edges = saved(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
