"""Connected components of an edge table by alternating star contractions, within frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.session import checkpointed


@dataclass(frozen=True)
class Contracted:
    #: f, node, root: of every node of an edge, the least node of its component.
    roots: DataFrame
    rounds: int


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """Nodes above a node move to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select("f", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("f", "u").agg(F.least(F.min("v"), F.col("u")).alias("to"))
    moved = both.where("v > u").join(least, ["f", "u"]).select("f", F.col("v").alias("u"), F.col("to").alias("v"))
    return moved.where("u > v").distinct()


def _chained(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    least = edges.groupBy("f", "u").agg(F.min("v").alias("to"))
    others = edges.join(least, ["f", "u"]).where("v != to").select("f", F.col("v").alias("u"), F.col("to").alias("v"))
    return others.unionByName(least.select("f", "u", F.col("to").alias("v"))).distinct()


def contract(edges: DataFrame, most: int = 100) -> Contracted:
    """edges: f, u, v (longs). A round is written to the checkpoint folder; rounds grow with the logarithm of the longest path.

    A round at which every edge leads to a root, and no root to another node, is the last: the edges are stars then.
    """
    now = checkpointed(edges.select("f", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    for done in range(most + 1):
        upper = now.select("f", F.col("u").alias("v"))
        settled = now.join(upper, ["f", "v"], "left_semi").isEmpty() and now.groupBy("f", "u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if settled:
            return Contracted(now.select("f", F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("f", F.col("v").alias("node"), F.col("v").alias("root")).distinct()), done)
        now = checkpointed(_chained(_least_neighbours(now)))
    raise RuntimeError(f"components did not settle in {most} rounds")
