"""Moment estimates, mixtures and least-squares losses of contacts on a grid, in columns; `moments` has moments and mixtures of dense frames in arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactigrid.session import checkpointed, ship_package

#: Components of a frame whose densities are expressions of their own.
WRITTEN_OUT = 8
CONTACT = "mean_x double, mean_y double, vx double, vy double, cv double"


def cluster_moments(labelled: DataFrame) -> DataFrame:
    """Per (f, label > 0): weight, mean, covariance, eigenvalues ev1 >= ev2 and orientation in [0, pi]; contacts have ev2 > 0."""
    inside = labelled.where("label > 0")
    s = inside.groupBy("f", "label").agg(
        F.sum("v").alias("sw"), F.max("v").alias("w_max"), *(F.sum(F.col("v") * e).alias(n) for n, e in (("s_x", F.col("x")), ("s_y", F.col("y")), ("s_xx", F.col("x") * F.col("x")), ("s_yy", F.col("y") * F.col("y")), ("s_xy", F.col("x") * F.col("y"))))
    )
    s = s.where("sw > 0")
    s = s.select("f", "label", "sw", "w_max", (F.col("s_x") / F.col("sw")).alias("mean_x"), (F.col("s_y") / F.col("sw")).alias("mean_y"), *(((F.col(a) - F.col(b) * F.col(c) / F.col("sw")) / F.col("sw")).alias(n) for n, a, b, c in (("vx", "s_xx", "s_x", "s_x"), ("vy", "s_yy", "s_y", "s_y"), ("cv", "s_xy", "s_x", "s_y"))))
    root = F.sqrt((F.col("vx") - F.col("vy")) ** 2 + 4 * F.col("cv") ** 2)
    s = s.withColumn("ev1", (F.col("vx") + F.col("vy") + root) / 2).withColumn("ev2", (F.col("vx") + F.col("vy") - root) / 2)
    qx, qy = F.col("vx") + F.col("cv") - F.col("ev2"), F.col("vy") + F.col("cv") - F.col("ev2")
    turn = math.pi - F.atan2(qx, qy)
    angle = F.when(turn < 0, turn + math.pi).when(turn > math.pi, turn - math.pi).otherwise(turn)
    return s.withColumn("angle", angle).withColumn("is_contact", F.col("ev2") > 0)


def mean_and_covariance(pixels: DataFrame) -> DataFrame:
    """Per frame: means and covariance, weighted by the values (divided by their sum), from one pass; pixels are neither sorted nor joined."""
    products = {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y")}
    s = pixels.groupBy("f").agg(F.sum("v").alias("total"), *(F.sum(F.col("v") * e).alias(n) for n, e in products.items())).where("total > 0")
    s = s.select("f", *((F.col(a) / F.col("total")).alias(n) for n, a in (("mean_x", "sx"), ("mean_y", "sy"), ("xx", "sxx"), ("xy", "sxy"), ("yy", "syy"))))
    return s.select("f", "mean_x", "mean_y", *((F.col(n) - F.col(f"mean_{n[0]}") * F.col(f"mean_{n[1]}")).alias(f"cov_{n}") for n in ("xx", "xy", "yy")))


def density(x: Column, y: Column, of: Column | None = None) -> Column:
    """Normal density with columns, or fields of a struct, mx, my, cxx, cxy, cyy."""
    get = (lambda n: F.col(n)) if of is None else (lambda n: of[n])
    det = get("cxx") * get("cyy") - get("cxy") * get("cxy")
    dx, dy = x - get("mx"), y - get("my")
    q = (get("cyy") * dx * dx - 2 * get("cxy") * dx * dy + get("cxx") * dy * dy) / det
    return F.exp(-q / 2) / (2 * math.pi * F.sqrt(det))


def mixture_step(pixels: DataFrame, params: DataFrame, hard: bool, least: float = 1e-20) -> DataFrame:
    """One iteration of a mixture: params (f, k, mx, my, cxx, cxy, cyy) to new ones.

    hard: a pixel goes to its densest component (the lowest k of equals); soft: in shares of the densities, none where their
    sum is at most `least`. Components of no weight are dropped.

    A frame's components, in order of k, come to its pixels as one array, so that a pixel's densities are in its own row:
    pixels, which are many, aren't sorted.
    """
    own = params.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("k", "mx", "my", "cxx", "cxy", "cyy"))).alias("own_"))
    most = own.agg(F.max(F.size("own_"))).first()[0] or 0
    d = pixels.select("f", "x", "y", "v").join(own.hint("shuffle_hash"), "f")
    at = lambda z: F.struct(z["k"].alias("k"), density(F.col("x"), F.col("y"), z).alias("p"))
    # A few components are written out, which Spark compiles; functions over arrays, for more of them, it doesn't.
    each = F.array(*(at(F.get("own_", F.lit(i))) for i in range(most))) if 0 < most <= WRITTEN_OUT else F.transform("own_", at)
    d = d.select("f", "x", "y", "v", each.alias("own_"))
    sums = [F.get("own_", F.lit(i)) for i in range(most)]
    if hard:
        best = F.array_max(F.transform("own_", lambda z, i: F.struct(z["p"].alias("p"), (-i).alias("i"), z["k"].alias("k"))))["k"]
        if 0 < most <= WRITTEN_OUT:
            top = F.greatest(*(z["p"] for z in sums)) if most > 1 else sums[0]["p"]
            best = F.coalesce(*(F.when(z["p"] == top, z["k"]) for z in sums), sums[0]["k"])
        d = d.select("f", "x", "y", best.alias("k"), F.col("v").alias("wv"))
    elif 0 < most <= WRITTEN_OUT:
        # Sums of each component beside each other: a pixel stays one row.
        d = d.select("f", "x", "y", "v", *(z["k"].alias(f"k{i}") for i, z in enumerate(sums)), *(z["p"].alias(f"p{i}") for i, z in enumerate(sums)))
        d = d.withColumn("total_", sum((F.coalesce(f"p{i}", F.lit(0.0)) for i in range(1, most)), F.coalesce("p0", F.lit(0.0))))
        d = d.select("f", "x", "y", *(f"k{i}" for i in range(most)), *((F.col("v") * F.when(F.col("total_") > least, F.col(f"p{i}") / F.col("total_")).otherwise(0.0)).alias(f"wv{i}") for i in range(most)))
        made = d.groupBy("f").agg(*(a for i in range(most) for a in (F.first(f"k{i}").alias(f"k{i}"), *(F.sum(F.col(f"wv{i}") * F.expr(e)).alias(f"{n}{i}") for n, e in _MOMENTS.items()))))
        s = made.select("f", F.inline(F.array(*(F.struct(F.col(f"k{i}").alias("k"), *(F.col(f"{n}{i}").alias(n) for n in _MOMENTS)) for i in range(most))))).where("k is not null and n > 0")
        return _of_moments(s)
    else:
        total = F.aggregate("own_", F.lit(0.0), lambda a, z: a + z["p"])
        d = d.select("*", total.alias("total_")).select("f", "x", "y", "v", "total_", F.inline("own_")).where("k is not null")
        d = d.select("f", "k", "x", "y", (F.col("v") * F.when(F.col("total_") > least, F.col("p") / F.col("total_")).otherwise(0.0)).alias("wv"))
    return _of_moments(d.groupBy("f", "k").agg(*(F.sum(F.col("wv") * F.expr(e)).alias(n) for n, e in _MOMENTS.items())).where("n > 0"))


#: Of the weights of a component.
_MOMENTS = {"n": "1", "sx": "x", "sy": "y", "sxx": "x * x", "sxy": "x * y", "syy": "y * y"}


def _of_moments(s: DataFrame) -> DataFrame:
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    return s.select("f", "k", mx.alias("mx"), my.alias("my"), (F.col("sxx") / F.col("n") - mx * mx).alias("cxx"), (F.col("sxy") / F.col("n") - mx * my).alias("cxy"), (F.col("syy") / F.col("n") - my * my).alias("cyy"))


def mixture_rounds(pixels, params: DataFrame, rounds: int, hard: bool = False, real: DataFrame | None = None, step: Callable[..., DataFrame] = mixture_step) -> tuple[DataFrame, DataFrame]:
    """(parameters after the last round, one row per round, f and k with the errors): against the real parameters, or else against the round before. A round is written to the checkpoint folder. step: another form of `mixture_step`, to which the pixels are given as they are."""
    told = None
    for turn in range(1, rounds + 1):
        new = checkpointed(step(pixels, params, hard))
        one = errors(new, params if real is None else real).select(F.lit(turn).alias("round"), "*")
        told, params = one if told is None else told.unionByName(one), new
    return params, told


def errors(found: DataFrame, real: DataFrame) -> DataFrame:
    """Per (f, k): L2 norm of the mean's error and infinity norm (largest row sum) of the covariance's. The join is by sorting: neither side goes to the driver."""
    d = found.alias("a").join(real.hint("merge").alias("b"), ["f", "k"])
    e = {n: F.col(f"b.{n}") - F.col(f"a.{n}") for n in ("mx", "my", "cxx", "cxy", "cyy")}
    return d.select("f", "k", F.hypot(e["mx"], e["my"]).alias("mean_error"), F.greatest(F.abs(e["cxx"]) + F.abs(e["cxy"]), F.abs(e["cxy"]) + F.abs(e["cyy"])).alias("cov_error"))


def squared_loss(pixels: DataFrame, params: DataFrame, delta: int | None = None) -> DataFrame:
    """Least-squares loss of c * exp(-q / 2) against the pixels and its gradients; params: f, c, mx, my, pxx, pxy, pyy.

    delta: only over the cells that are so near to the rounded mean (halves to even) in x and y.
    """
    d = pixels.select("f", "x", "y", "v").join(params, "f")
    if delta is not None:
        d = d.where((F.abs(F.col("x") - F.rint("mx")) <= delta) & (F.abs(F.col("y") - F.rint("my")) <= delta))
    d = d.withColumn("dx", F.col("x") - F.col("mx")).withColumn("dy", F.col("y") - F.col("my"))
    d = d.withColumn("e", F.exp(-(F.col("pxx") * F.col("dx") ** 2 + 2 * F.col("pxy") * F.col("dx") * F.col("dy") + F.col("pyy") * F.col("dy") ** 2) / 2)).withColumn("r", F.col("c") * F.col("e") - F.col("v"))
    re = F.col("r") * F.col("e")
    gx, gy = F.col("pxx") * F.col("dx") + F.col("pxy") * F.col("dy"), F.col("pxy") * F.col("dx") + F.col("pyy") * F.col("dy")
    return d.groupBy("f").agg(
        F.sum(F.col("r") * F.col("r")).alias("loss"),
        (2 * F.sum(re)).alias("d_c"),
        (2 * F.sum(F.col("c") * re * gx)).alias("d_mx"),
        (2 * F.sum(F.col("c") * re * gy)).alias("d_my"),
        (-F.sum(F.col("c") * re * F.col("dx") * F.col("dx"))).alias("d_pxx"),
        (-F.sum(F.col("c") * re * F.col("dx") * F.col("dy"))).alias("d_pxy"),
        (-F.sum(F.col("c") * re * F.col("dy") * F.col("dy"))).alias("d_pyy"),
    )


def minimise(function, x: np.ndarray, rounds: int = 60, tolerance: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """BFGS with backtracking; function returns (value, gradient). The place, the largest slope there, and whether it is within the tolerance.

    Otherwise the rounds didn't suffice, or no step along the slope lowered the value any more.
    """
    value, slope = function(x)
    inverse = np.eye(len(x))
    for _ in range(rounds):
        if np.abs(slope).max() < tolerance:
            break
        direction = -inverse @ slope
        if direction @ slope >= 0:
            inverse, direction = np.eye(len(x)), -slope
        step = 1.0
        while step > 1e-12:
            new_value, new_slope = function(x + step * direction)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * step * (direction @ slope):
                break
            step /= 2
        else:
            break
        s, y = step * direction, new_slope - slope
        x, value, slope = x + s, new_value, new_slope
        if (sy := s @ y) > 1e-14:
            left = np.eye(len(x)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
    steepest = float(np.abs(slope).max())
    return x, steepest, steepest < tolerance


def least_squares_fit(pixels: DataFrame, start: DataFrame, delta: int | None = None) -> DataFrame:
    """Gaussians of each frame jointly by BFGS from start (f, k, c, mx, my, pxx, pxy, pyy, a row per Gaussian) to the same with the frame's loss.

    `slope` is the largest component of the gradient at the end, `converged` whether that is small enough to be a minimum: rounds and
    steps are bounded. A frame is one group of pixels. delta: only over the cells that are so near to one of the rounded start means.
    """
    ship_package(pixels.sparkSession)
    names = ["c", "mx", "my", "pxx", "pxy", "pyy"]

    def fit(group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("k")
        if not len(given) or not len(group):
            return pd.DataFrame(columns=["f", "k", *names, "loss", "slope", "converged"])
        x, y, v = (group[n].to_numpy(float) for n in ("x", "y", "v"))
        first = given[names].to_numpy(float)
        if delta is not None:
            near = np.any([(np.abs(x - np.rint(m[1])) <= delta) & (np.abs(y - np.rint(m[2])) <= delta) for m in first], axis=0)
            x, y, v = x[near], y[near], v[near]

        def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
            p = flat.reshape(-1, 6)[:, :, None]
            dx, dy = x - p[:, 1], y - p[:, 2]
            with np.errstate(over="ignore", invalid="ignore"):
                e = np.exp(-(p[:, 3] * dx * dx + 2 * p[:, 4] * dx * dy + p[:, 5] * dy * dy) / 2)
                r = (p[:, 0] * e).sum(0) - v
                re = p[:, 0] * r * e
                slopes = [2 * (r * e).sum(1), 2 * (re * (p[:, 3] * dx + p[:, 4] * dy)).sum(1), 2 * (re * (p[:, 4] * dx + p[:, 5] * dy)).sum(1), -(re * dx * dx).sum(1), -2 * (re * dx * dy).sum(1), -(re * dy * dy).sum(1)]
                return float(r @ r), np.stack(slopes, 1).ravel()

        p, slope, converged = minimise(loss, first.ravel())
        out = pd.DataFrame(p.reshape(-1, 6), columns=names)
        return pd.concat([given[["f", "k"]].reset_index(drop=True), out], axis=1).assign(loss=loss(p)[0], slope=slope, converged=converged)

    many = start if "k" in start.columns else start.withColumn("k", F.lit(0))
    return pixels.select("f", "x", "y", "v").groupBy("f").cogroup(many.select(F.col("f").alias("f"), "k", *names).groupBy("f")).applyInPandas(fit, "f long, k int, " + ", ".join(f"{n} double" for n in (*names, "loss", "slope")) + ", converged boolean")


def reconstruction_error(parts: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per frame, the mean squared difference of the sum of parts (f, x, y, v) and the pixels."""
    total = parts.groupBy("f", "x", "y").agg(F.sum("v").alias("part"))
    return pixels.join(total, ["f", "x", "y"], "left").groupBy("f").agg(F.avg((F.coalesce("part", F.lit(0.0)) - F.col("v")) ** 2).alias("mse"))
