"""Stage timings and overlay geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tactigrid.functions.matrices import eigenvalues, eigenvector
from tactigrid.operators.dense import STAGES


def stage_metrics(durations: DataFrame) -> DataFrame:
    """durations: stage, us. Count, total, mean, sample variance and deviation, extremes; microseconds throughout."""
    return durations.groupBy("stage").agg(F.count("us").alias("n"), F.sum("us").alias("total_us"), F.avg("us").alias("mean_us"), F.var_samp("us").alias("var_us2"), F.stddev_samp("us").alias("stddev_us"), F.min("us").alias("min_us"), F.max("us").alias("max_us"))


def observed_stages(timed: DataFrame, observation: Observation) -> DataFrame:
    """The contacts of `fit.touch_points(timed=True)`; the action that reads them also fills the observation, see `stages_of`."""
    sums = [F.count_if(F.col("stage").isNull()).alias("contacts")]
    for stage in STAGES:
        own = F.when(F.col("stage") == stage, F.col("us"))
        each = own / F.col("n")
        sums += [F.sum(F.when(F.col("stage") == stage, F.col("n"))).alias(f"{stage}:n"), F.sum(own).alias(f"{stage}:total_us"), F.sum(own * each).alias(f"{stage}:squares"), F.min(each).alias(f"{stage}:min_us"), F.max(each).alias(f"{stage}:max_us")]
    return timed.observe(observation, *sums).where("stage is null").drop("stage", "n", "us")


def stages_of(seen: dict) -> tuple[int, list[dict]]:
    """Contacts, and of each stage (in order): stage, frames, total, mean and deviation (of the batches' means), least and most microseconds of a frame, of an observation's values."""
    out = []
    for stage in STAGES:
        n, total, squares, low, high = (seen.get(f"{stage}:{k}") or 0 for k in ("n", "total_us", "squares", "min_us", "max_us"))
        mean = total / n if n else 0.0
        out.append({"stage": stage, "n": n, "total_us": float(total), "mean_us": mean, "stddev_us": math.sqrt(max(squares / n - mean * mean, 0.0)) if n else 0.0, "min_us": float(low), "max_us": float(high)})
    return seen.get("contacts") or 0, out


def ellipses(points: DataFrame, height: int | None = None, sigmas: float = 1.0) -> DataFrame:
    """From mean and cov: half axes (times sigmas), rotation, aspect, and the centre with y flipped if a height is given."""
    xx, xy, yy = F.col("cov.xx"), F.col("cov.xy"), F.col("cov.yy")
    e1, e2 = eigenvalues(xx, xy, yy)
    vx, vy = eigenvector(xx, xy, yy, e1)
    a, b = sigmas * F.sqrt(F.abs(e1)), sigmas * F.sqrt(F.abs(e2))
    y = (height - 1) - F.col("mean.y") if height else F.col("mean.y")
    return points.select("*", a.alias("axis_1"), b.alias("axis_2"), F.atan2(vx, vy).alias("rotation"), F.when(F.least(a, b) > 0, F.greatest(a, b) / F.least(a, b)).alias("aspect"), F.col("mean.x").alias("centre_x"), y.alias("centre_y"))


def overlay(found: DataFrame, cross: float = 1.0) -> DataFrame:
    """What is drawn over a frame, one row per segment, from ellipses: kind (`axis_1`, `axis_2`, `cross_x`, `cross_y`), its ends and the contact's number; the outlines and texts are in `outlines` and `captions`."""
    cx, cy, turn = F.col("centre_x"), F.col("centre_y"), F.col("rotation")
    ends = {"axis_1": (F.col("axis_1") * F.sin(turn), F.col("axis_1") * F.cos(turn)), "axis_2": (F.col("axis_2") * F.cos(turn), -F.col("axis_2") * F.sin(turn)), "cross_x": (F.lit(cross), F.lit(0.0)), "cross_y": (F.lit(0.0), F.lit(cross))}
    segment = F.array(*(F.struct(F.lit(k).alias("kind"), (cx - dx).alias("x1"), (cy - dy).alias("y1"), (cx + dx).alias("x2"), (cy + dy).alias("y2")) for k, (dx, dy) in ends.items()))
    return found.select(*(c for c in found.columns if c in ("f", "touch_id")), F.inline(segment))


def outlines(found: DataFrame, pieces: int = 32) -> DataFrame:
    """The ellipses as `pieces` segments each, in the shape of `overlay`'s rows."""
    cx, cy, turn = F.col("centre_x"), F.col("centre_y"), F.col("rotation")

    def at(k: Column) -> tuple[Column, Column]:
        along, across = F.col("axis_1") * F.cos(k * (2 * math.pi / pieces)), F.col("axis_2") * F.sin(k * (2 * math.pi / pieces))
        return cx + along * F.sin(turn) + across * F.cos(turn), cy + along * F.cos(turn) - across * F.sin(turn)

    each = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece_"))
    (x1, y1), (x2, y2) = at(F.col("piece_")), at(F.col("piece_") + 1)
    return each.select(*(c for c in found.columns if c in ("f", "touch_id")), F.lit("ellipse").alias("kind"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def captions(found: DataFrame) -> DataFrame:
    """The texts beside each contact: confidence, aspect and scale with two digits, above each other, with their places."""
    texts = ((3.0, "c:%.2f", "confidence"), (2.0, "a:%.2f", "aspect"), (1.0, "s:%.2f", "scale"))
    lines = F.array(*(F.struct((F.col("centre_x") - 3.5).alias("x"), (F.col("centre_y") + dy).alias("y"), F.format_string(form, F.col(c)).alias("text")) for dy, form, c in texts))
    return found.select(*(c for c in found.columns if c in ("f", "touch_id")), F.inline(lines))
