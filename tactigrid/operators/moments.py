"""Moments and mixtures of dense frames, in arrays: the same as the columns of `mixture`, for frames that a task can hold.

Sums are made where a frame's cells are, along x and then along y: no cell becomes a row, and nothing is joined or sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.operators import mixture
from tactigrid.operators.batches import Columns, rows_of_frames

_COMPONENT = ("mx", "my", "cxx", "cxy", "cyy")


def mean_and_covariance(frames: DataFrame) -> DataFrame:
    """f, mean_x, mean_y, cov_xx, cov_xy, cov_yy; see `mixture.mean_and_covariance`. Covariances are summed about the means."""

    def run(stack: np.ndarray) -> Iterator[Columns]:
        _, h, w = stack.shape
        with np.errstate(all="ignore"):
            along, down, total = stack.sum(1), stack.sum(2), stack.sum((1, 2))
            mean_x, mean_y = along @ np.arange(float(w)) / total, down @ np.arange(float(h)) / total
            dx, dy = np.arange(w) - mean_x[:, None], np.arange(h) - mean_y[:, None]
            crossed = (stack @ dx[:, :, None])[:, :, 0] * dy
            found = {"mean_x": mean_x, "mean_y": mean_y, **{f"cov_{n}": s.sum(1) / total for n, s in (("xx", along * dx * dx), ("xy", crossed), ("yy", down * dy * dy))}}
        rows = np.flatnonzero(~(total <= 0))  # as in columns, a sum that is no number is above all others
        yield {"frame": rows, **{n: v[rows] for n, v in found.items()}}

    return rows_of_frames(frames, run, dict.fromkeys(("mean_x", "mean_y", "cov_xx", "cov_xy", "cov_yy"), "double"))


def _density(at: Columns, w: int, h: int) -> np.ndarray:
    """Of one component for each of some frames, over their cells; no number if its covariance is singular."""
    mx, my, cxx, cxy, cyy = (at[n][:, None] for n in _COMPONENT)
    det = cxx * cyy - cxy * cxy
    dx, dy = np.arange(w) - mx, np.arange(h) - my
    q = (-2 * cxy * dy)[:, :, None] * dx[:, None, :]
    q += (cyy * dx * dx)[:, None, :]
    q += (cxx * dy * dy)[:, :, None]
    q /= -2 * det[:, :, None]
    return np.exp(q, out=q) / (2 * math.pi * np.sqrt(det))[:, :, None]


def _moments(weights: np.ndarray) -> Columns:
    """The parameters of weights over the cells of some frames, and n, their sum."""
    _, h, w = weights.shape
    powers = [np.stack([np.ones(size), np.arange(size), np.arange(size) ** 2.0]) for size in (w, h)]
    s = powers[1] @ (weights.reshape(-1, w) @ powers[0].T).reshape(-1, h, 3)
    n = s[:, 0, 0]
    mx, my = s[:, 0, 1] / n, s[:, 1, 0] / n
    return {"n": n, "mx": mx, "my": my, "cxx": s[:, 0, 2] / n - mx * mx, "cxy": s[:, 1, 1] / n - mx * my, "cyy": s[:, 2, 0] / n - my * my}


def _updated(stack: np.ndarray, flat: Columns, counts: np.ndarray, hard: bool, least: float) -> Iterator[Columns]:
    """The new components of a stack's frames, which have so many each of the flat ones; worked on by their number within the frame, so memory doesn't follow it."""
    n, h, w = stack.shape
    first, rounds = np.cumsum(counts) - counts, range(counts.max(initial=0))

    def of(i: int) -> tuple[np.ndarray, np.ndarray]:
        has = np.flatnonzero(counts > i)
        return has, first[has] + i

    def density(which: np.ndarray) -> np.ndarray:
        return _density({c: flat[c][which] for c in _COMPONENT}, w, h)

    with np.errstate(all="ignore"):
        top, best = np.full((n, h, w), -1.0), np.zeros((n, h, w), np.int32)  # of the densest component
        total = np.zeros((n, h, w))
        for i in rounds:
            has, which = of(i)
            p = density(which)
            if hard:
                more = (p > top[has]) | (np.isnan(p) & ~np.isnan(top[has]))
                top[has], best[has] = np.where(more, p, top[has]), np.where(more, i, best[has])
            else:
                total[has] += p
        for i in rounds:
            has, which = of(i)
            if hard:
                weights = np.where(best[has] == i, stack[has], 0.0)
            else:
                weights = stack[has] * np.where(total[has] <= least, 0.0, density(which) / total[has])
            found = _moments(weights)
            kept = ~(found.pop("n") <= 0)
            yield {"frame": has[kept], "k": flat["k"][which][kept], **{c: v[kept] for c, v in found.items()}}


def components(params: DataFrame) -> DataFrame:
    """params (f, k, mx, my, cxx, cxy, cyy) as a row for each frame: f and components, an array in order of k."""
    each = F.struct(F.col("k").cast("long").alias("k"), *(F.col(c).cast("double").alias(c) for c in _COMPONENT))
    return params.groupBy("f").agg(F.array_sort(F.collect_list(each)).alias("components"))


def mixture_step(frames: DataFrame, hard: bool, least: float = 1e-20) -> DataFrame:
    """One iteration of a mixture on frames (f, w, h, px, components): the new f, k, mx, my, cxx, cxy, cyy; see `mixture.mixture_step`."""

    def run(stack: np.ndarray, given: pa.ListArray) -> Iterator[Columns]:
        flat = given.flatten()
        columns = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("k", *_COMPONENT)}
        return _updated(stack, columns, given.value_lengths().to_numpy(zero_copy_only=False), hard, least)

    return rows_of_frames(frames, run, {"k": "long", **dict.fromkeys(_COMPONENT, "double")}, ("components",))


def mixture_rounds(frames: Callable[[DataFrame], DataFrame], params: DataFrame, rounds: int, hard: bool = False, real: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """See `mixture.mixture_rounds`; the function gives the frames beside the components that it gets, which are others each round."""

    def step(made: Callable[[DataFrame], DataFrame], now: DataFrame, hard: bool) -> DataFrame:
        return mixture_step(made(components(now)), hard).withColumn("k", F.col("k").cast(params.schema["k"].dataType))

    return mixture.mixture_rounds(frames, params, rounds, hard, real, step)
