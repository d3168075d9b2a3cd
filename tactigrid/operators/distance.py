"""Cost-weighted distances on the grid, and the soft masks made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.operators import dense
from tactigrid.operators.batches import map_pixels
from tactigrid.session import checkpointed, ship_package


def distance_frames(frames: DataFrame, limit: float = 6.0, step: float = 0.1, connectivity: int = 4) -> DataFrame:
    """Dense (f, w, h, source, mask, cost) to (f, w, h, distance); unreached cells are null."""
    ship_package(frames.sparkSession)

    def run(source: np.ndarray, mask: np.ndarray, cost: np.ndarray) -> np.ndarray:
        return dense.distances(source > 0, mask > 0, cost, limit, step, connectivity)

    wanted = frames.select("f", "w", "h", F.transform("source", lambda v: v.cast("double")).alias("source"), F.transform("mask", lambda v: v.cast("double")).alias("mask"), F.transform("cost", lambda v: v.cast("double")).alias("cost"))
    found = wanted.mapInArrow(map_pixels(run, ["source", "mask", "cost"], "distance", pa.float64()), "f long, w int, h int, distance array<double>")
    return found.withColumn("distance", F.transform("distance", lambda d: F.when(d < float("inf"), d)))


def distance_relational(pixels: DataFrame, limit: float = 6.0, step: float = 0.1, rounds: int | None = None, connectivity: int = 4) -> DataFrame:
    """The same from long pixels (f, x, y, source, mask, cost): a frontier is relaxed until nothing improves. f, x, y, distance."""
    cells = checkpointed(pixels.select("f", "x", "y", "source", "mask", F.col("cost").cast("double").alias("cost")))
    state = checkpointed(cells.where("source").select("f", "x", "y", F.lit(0.0).alias("distance")))
    front = state
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else [])
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(step * (2**0.5 if dx and dy else 1.0)).alias("length")) for dx, dy in near))
    rounds = rounds or int(limit / step) + 2  # every step is at least so long
    for _ in range(rounds):
        leave = front.join(cells.select("f", "x", "y", "cost"), ["f", "x", "y"]).select("f", "x", "y", (F.col("distance") + F.col("cost")).alias("d"), F.explode(steps).alias("s")).withColumn("d", F.col("d") + F.col("s.length"))
        arrive = leave.where(F.col("d") < limit).groupBy("f", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).agg(F.min("d").alias("d"))
        allowed = arrive.join(cells.where("mask and not source").select("f", "x", "y"), ["f", "x", "y"])
        better = checkpointed(allowed.join(state, ["f", "x", "y"], "left").where("distance is null or d < distance").select("f", "x", "y", F.col("d").alias("distance")))
        if better.isEmpty():
            break
        state = checkpointed(state.join(better, ["f", "x", "y"], "left_anti").unionByName(better))
        front = better
    else:
        raise RuntimeError(f"distances did not settle in {rounds} rounds")
    return state


def masks(pixels: DataFrame, chosen: Column, with_sources: bool = False) -> DataFrame:
    """From v, label: source (chosen components) and mask (positive background; with_sources: and the chosen components)."""
    source = (F.col("label") > 0) & chosen
    open_ = (F.col("v") > 0) & ((F.col("label") == 0) | source if with_sources else F.col("label") == 0)
    return pixels.withColumn("source", source).withColumn("mask", open_)


def contact_cost(ridge: Column, e1: Column, e2: Column) -> Column:
    """Cost of leaving a pixel in the contact pipeline."""
    return 9 * ridge + F.greatest(e1, F.lit(0.0)) + F.greatest(e2, F.lit(0.0))


def soft_weight(distance: Column, sigma: float = 1.0) -> Column:
    """exp(-(d / sigma)^2), 0 where a cell wasn't reached."""
    return F.coalesce(F.exp(-F.pow(distance / sigma, F.lit(2.0))), F.lit(0.0))


def soft_mask(inside: Column, outside: Column, sigma: float = 1.0) -> Column:
    total = soft_weight(inside, sigma) + soft_weight(outside, sigma)
    return F.when(total > 0, soft_weight(inside, sigma) / total).otherwise(0.0)


def decomposition_weights(df: DataFrame, sigma: float = 1.0, least: float = 1e-10) -> DataFrame:
    """Distances of any number of label sets (f, x, y, set, distance) to weights that sum to 1 where any set reaches."""
    raw = soft_weight(F.col("distance"), sigma)
    d = df.withColumn("raw_", F.when(raw >= least, raw).otherwise(0.0))
    total = F.sum("raw_").over(Window.partitionBy("f", "x", "y"))
    return d.withColumn("weight", F.when(total > 0, F.col("raw_") / total).otherwise(0.0)).drop("raw_")
