"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the node's smallest neighbour (or to the node, if that is smaller)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.withColumnRenamed("m", "v"))


def components(edges: DataFrame, u: str, v: str, rounds: int = 100) -> DataFrame:
    """(node, root): of every node of an edge, the smallest node that it is connected with.

    The minimum of a neighbourhood is an aggregate, so hubs are combined before the shuffle; a round is written to the
    checkpoint folder. Rows: at most twice the edges in every round; rounds grow with the logarithm of the path length.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct()
    now, before = checkpointed(now), None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        now = checkpointed(_small_star(_large_star(now).distinct()).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
