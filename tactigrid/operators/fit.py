"""Joint Gaussian fits of candidates: one iteration in columns, for frames of any size; `touch_points` and `windows` have them in arrays.

Candidates are rows (f, c, scale, mx, my, pxx, pxy, pyy, xmin, xmax, ymin, ymax). A candidate's window is generated cell by
cell and equi-joined with the pixels, never matched by a range condition; the join is by sorting, as neither side's size is known
beforehand (cells are some hundred times what they are made of) and neither may go to the driver. Coordinates are rescaled to [-1, 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions.matrices import EPS, gaussian_like, inverse, larger_root
from tactigrid.operators import dense
from tactigrid.operators.batches import stacks
from tactigrid.session import checkpointed, ship_package
from tactigrid.sources.frames import STACK, partitions_of

MOMENTS = [(i, j) for i in range(5) for j in range(5) if i + j <= 4]
RIGHTS = [(i, j) for i in range(3) for j in range(3) if i + j <= 2]
#: Exponents and factor of the monomials of the fitted quadratic: x^2, 2xy, y^2, x, y, 1.
_BASIS = [(2, 0, 1), (1, 1, 2), (0, 2, 1), (1, 0, 1), (0, 1, 1), (0, 0, 1)]
LOG_EPS = 2.0**-52
#: Of a fitted Gaussian. A scale beyond a double's exponents is 0 or infinite; log_scale tells it then, too.
PARAMETERS = ("scale", "mx", "my", "pxx", "pxy", "pyy", "log_scale")


def candidates(maxima: DataFrame, window: int = 11) -> DataFrame:
    """From maxima (f, x, y, w, h): unit Gaussians with their clamped windows, in rescaled coordinates."""
    half = (window - 1) // 2
    return maxima.select(
        "f",
        "w",
        "h",
        (F.col("y") * F.col("w") + F.col("x")).cast("long").alias("c"),
        F.lit(1.0).alias("scale"),
        (F.col("x") * 2 / F.col("w") - 1).alias("mx"),
        (F.col("y") * 2 / F.col("h") - 1).alias("my"),
        (F.col("w") * F.col("w") / 4).alias("pxx"),
        F.lit(0.0).alias("pxy"),
        (F.col("h") * F.col("h") / 4).alias("pyy"),
        F.greatest(F.col("x") - half, F.lit(0)).alias("xmin"),
        F.least(F.col("x") + half, F.col("w") - 1).alias("xmax"),
        F.greatest(F.col("y") - half, F.lit(0)).alias("ymin"),
        F.least(F.col("y") + half, F.col("h") - 1).alias("ymax"),
    )


def window_pixels(cands: DataFrame, pixels: DataFrame) -> DataFrame:
    """One row per candidate and cell of its window: the candidate's columns, x, y, v and rescaled sx, sy."""
    cells = cands.select("*", F.explode(F.sequence("xmin", "xmax")).alias("x")).select("*", F.explode(F.sequence("ymin", "ymax")).alias("y"))
    joined = cells.join(pixels.select("f", "x", "y", "v").hint("merge"), ["f", "x", "y"])
    return joined.withColumn("sx", F.col("x") * 2 / F.col("w") - 1).withColumn("sy", F.col("y") * 2 / F.col("h") - 1)


def responsibilities(windows: DataFrame) -> DataFrame:
    """Adds g (the candidate's Gaussian) and share: g over the sum at the cell, or g where the sum is 0."""
    g = F.col("scale") * gaussian_like(F.col("pxx"), F.col("pxy"), F.col("pyy"), F.col("sx") - F.col("mx"), F.col("sy") - F.col("my"))
    d = windows.withColumn("g", g).withColumn("total_", F.sum("g").over(Window.partitionBy("f", "x", "y")))
    return d.withColumn("share", F.when(F.col("total_") > 0, F.col("g") / F.col("total_")).otherwise(F.col("g"))).drop("total_")


def _power(i: int, j: int) -> Column:
    out = F.lit(1.0)
    for _ in range(i):
        out *= F.col("sx")
    for _ in range(j):
        out *= F.col("sy")
    return out


def normal_equations(shared: DataFrame, weighted: bool = True, least: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per candidate: moments m_ij = sum d^2 x^i y^j and r_ij = sum d^2 ln(d + eps) x^i y^j, d = v * share.

    Not weighted: with 1 instead of d^2. least: cells with a smaller d are left out, and ln d needs no eps.
    """
    d = shared.withColumn("d", F.col("v") * F.col("share"))
    if least is not None:
        d = d.where(F.col("d") >= least)
    d = d.withColumn("dd", F.col("d") * F.col("d") if weighted else F.lit(1.0))
    d = d.withColumn("dl", F.col("dd") * F.log(F.col("d") + (LOG_EPS if least is None else 0.0)))
    aggs = [F.sum(F.col("dd") * _power(i, j)).alias(f"m{i}{j}") for i, j in MOMENTS]
    return d.groupBy("f", "c").agg(*(F.first(k).alias(k) for k in keep), *aggs, *(F.sum(F.col("dl") * _power(i, j)).alias(f"r{i}{j}") for i, j in RIGHTS))


def gaussians(at: dict[str, np.ndarray], centre: tuple[np.ndarray, ...] = (), unit: float | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(rows, PARAMETERS) of the systems that have a solution with a regular precision; in pixels, if their unit from the centre is told."""
    matrix = np.stack([np.stack([s * t * at[f"m{i + k}{j + n}"] for k, n, t in _BASIS], -1) for i, j, s in _BASIS], -2)
    right = np.stack([s * at[f"r{i}{j}"] for i, j, s in _BASIS], -1)
    solved, chi = dense.solved(matrix, right)
    rows, q = np.flatnonzero(solved), chi.T
    pxx, pxy, pyy = -2 * q[0], -2 * q[1], -2 * q[2]
    det = pxx * pyy - pxy * pxy
    with np.errstate(all="ignore"):
        mx, my = (pyy * q[3] - pxy * q[4]) / det, (pxx * q[4] - pxy * q[3]) / det
        log_scale = q[5] + (pxx * mx * mx + 2 * pxy * mx * my + pyy * my * my) / 2
        scale = np.exp(log_scale)
    good = (np.abs(det) > 1e-40) & np.isfinite(mx) & np.isfinite(my)
    if unit:
        cx, cy = (c[rows] for c in centre)
        mx, my, pxx, pxy, pyy = cx + unit * mx, cy + unit * my, pxx / unit**2, pxy / unit**2, pyy / unit**2
    return rows[good], {n: v[good] for n, v in zip(PARAMETERS, (scale, mx, my, pxx, pxy, pyy, log_scale), strict=True)}


def parameters(equations: DataFrame, unit: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """f, c and PARAMETERS from the symmetric 6x6 systems, solved in batches; candidates with a singular system or precision are dropped. Columns named in keep follow.

    In the equations' coordinates, or, if these are in a unit from the centre that the columns cx and cy name, in pixels.
    """
    ship_package(equations.sparkSession)
    centre = ["cx", "cy"] if unit else []
    moments, rights = [f"m{i}{j}" for i, j in MOMENTS], [f"r{i}{j}" for i, j in RIGHTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in (*centre, *moments, *rights)}
            rows, found = gaussians(at, tuple(at[k] for k in centre), unit)
            keys, kept = ([batch.column(c).take(pa.array(rows)) for c in some] for some in (("f", "c"), keep))
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(found[n]) for n in PARAMETERS), *kept], names=["f", "c", *PARAMETERS, *keep])

    kinds = [f"{k} {equations.schema[k].dataType.simpleString()}" for k in keep]
    return equations.select("f", "c", *dict.fromkeys([*centre, *keep]), *moments, *rights).mapInArrow(run, ", ".join(["f long, c long", *(f"{n} double" for n in PARAMETERS), *kinds]))


def iterate(cands: DataFrame, pixels: DataFrame, unit: float = 5.0) -> DataFrame:
    """One iteration in columns: candidates with their new parameters; failed ones are gone.

    Those that come with an infinite scale are given up, as they leave no shares to others. The systems are set up in
    coordinates from the window's centre: the solution is the same in any, and these keep the systems well conditioned.
    """
    shared = responsibilities(window_pixels(cands.where(F.abs("scale") < math.inf), pixels))
    shared = shared.withColumn("cx", (F.col("xmin") + F.col("xmax")) / 2).withColumn("cy", (F.col("ymin") + F.col("ymax")) / 2)
    shared = shared.withColumn("sx", (F.col("x") - F.col("cx")) / unit).withColumn("sy", (F.col("y") - F.col("cy")) / unit)
    own = ("w", "h", "xmin", "xmax", "ymin", "ymax")
    return _rescaled(parameters(normal_equations(shared, keep=("cx", "cy", *own)), unit, own).select("f", "c", *own, *PARAMETERS))


def _rescaled(cands: DataFrame) -> DataFrame:
    """From pixels to the frame's coordinates in [-1, 1)."""
    sx, sy = F.lit(2.0) / F.col("w"), F.lit(2.0) / F.col("h")
    return cands.withColumns({"mx": F.col("mx") * sx - 1, "my": F.col("my") * sy - 1, "pxx": F.col("pxx") / (sx * sx), "pxy": F.col("pxy") / (sx * sy), "pyy": F.col("pyy") / (sy * sy)})


def area(cands: DataFrame, delta: int) -> DataFrame:
    """Windows about the rounded mean (halves to even), cut at the frame: xmin, xmax, ymin, ymax (inclusive); those without a cell are gone."""
    px, py = F.rint("mx").cast("int"), F.rint("my").cast("int")
    cut = {"xmin": F.greatest(px - delta, F.lit(0)), "xmax": F.least(px + delta, F.col("w") - 1), "ymin": F.greatest(py - delta, F.lit(0)), "ymax": F.least(py + delta, F.col("h") - 1)}
    return cands.withColumns(cut).where("xmin <= xmax and ymin <= ymax")


def data_maps(cands: DataFrame, pixels: DataFrame, delta: int) -> DataFrame:
    """One row per candidate and cell of its area, with share: its density over the sum of the candidates whose areas hold the cell, 0 where that is 0."""
    cells = area(cands, delta).select("*", F.explode(F.sequence("xmin", "xmax")).alias("x")).select("*", F.explode(F.sequence("ymin", "ymax")).alias("y"))
    d = cells.join(pixels.select("f", "x", "y", "v").hint("merge"), ["f", "x", "y"])
    size = F.sqrt(F.col("pxx") * F.col("pyy") - F.col("pxy") * F.col("pxy")) / (2 * math.pi)
    d = d.withColumn("g", size * gaussian_like(F.col("pxx"), F.col("pxy"), F.col("pyy"), F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    total = F.sum("g").over(Window.partitionBy("f", "x", "y"))
    return d.withColumn("total_", total).withColumn("share", F.when(F.col("total_") != 0, F.col("g") / F.col("total_")).otherwise(0.0)).drop("total_")


def refit(cands: DataFrame, pixels: DataFrame, delta: int = 2, weighted: bool = True, least: float = 1e-20) -> DataFrame:
    """One round with windows about the current means: candidates (f, c, w, h, scale, mx, my, pxx, pxy, pyy in pixels) to new ones.

    Singular systems, and results that aren't positive definite, are dropped.
    """
    unit = float(max(1, delta))
    shared = data_maps(cands, pixels, delta).withColumn("cx", F.rint("mx")).withColumn("cy", F.rint("my"))
    moved = shared.withColumn("sx", (F.col("x") - F.col("cx")) / unit).withColumn("sy", (F.col("y") - F.col("cy")) / unit)
    d = parameters(normal_equations(moved, weighted, least, ("cx", "cy", "w", "h")), unit, ("w", "h")).select("f", "c", "w", "h", *PARAMETERS)
    return d.where((F.col("pxx") * F.col("pyy") - F.col("pxy") * F.col("pxy") > 0) & (F.col("pxx") + F.col("pyy") > 0))


def fit_multi(cands: DataFrame, pixels: DataFrame, rounds: int = 3, delta: int = 3, weighted: bool = True) -> DataFrame:
    """Joint fit whose windows follow the means; a round is written to the checkpoint folder."""
    spark = pixels.sparkSession
    for turn in range(rounds):
        dealt = cands.repartition(partitions_of(spark), "f") if turn else cands  # by candidate, not by cell
        cands = checkpointed(refit(dealt, pixels, delta, weighted))
    return cands


def starts(maxima: DataFrame) -> DataFrame:
    """From maxima (f, x, y, w, h): unit Gaussians in pixels, for `refit`."""
    return maxima.select("f", (F.col("y") * F.col("w") + F.col("x")).cast("long").alias("c"), "w", "h", F.lit(1.0).alias("scale"), F.col("x").cast("double").alias("mx"), F.col("y").cast("double").alias("my"), F.lit(1.0).alias("pxx"), F.lit(0.0).alias("pxy"), F.lit(1.0).alias("pyy"))


def with_confidence(points: DataFrame, scored: DataFrame) -> DataFrame:
    """Adds to fits (f, w, h, mx, my) the score of the pixel under the mean, cut at the frame; scored: f, x, y, score."""
    place = lambda m, n: F.least(F.greatest(F.col(m).cast("int"), F.lit(0)), F.col(n) - 1)
    d = points.withColumn("x", place("mx", "w")).withColumn("y", place("my", "h"))
    return d.join(scored.select("f", "x", "y", F.col("score").alias("confidence")), ["f", "x", "y"], "left").drop("x", "y")


def in_pixels(cands: DataFrame) -> DataFrame:
    """Undoes the rescaling of means and precisions."""
    sx, sy = F.lit(2.0) / F.col("w"), F.lit(2.0) / F.col("h")
    return cands.withColumns({"mx": (F.col("mx") + 1) / sx, "my": (F.col("my") + 1) / sy, "pxx": F.col("pxx") * sx * sx, "pxy": F.col("pxy") * sx * sy, "pyy": F.col("pyy") * sy * sy})


def accepted(cands: DataFrame, max_aspect: float = 2.0) -> DataFrame:
    """Adds cov (struct) and aspect; drops singular, degenerate and elongated fits.

    The aspect is that of the precision, whose eigenvalues are the covariance's inverses: the filter stays a short expression.
    """
    tr, det = F.col("pxx") + F.col("pyy"), F.col("pxx") * F.col("pyy") - F.col("pxy") * F.col("pxy")
    d = cands.withColumn("l1_", F.abs(larger_root(tr, det, 1e-40)))
    d = d.withColumn("l2_", F.when(F.col("l1_") > 0, F.abs(det) / F.col("l1_")))
    aspect = F.when((F.col("l1_") > EPS) & (F.col("l2_") > EPS), F.sqrt(F.greatest("l1_", "l2_") / F.least("l1_", "l2_")))
    d = d.withColumn("aspect", aspect).where(F.col("aspect") <= max_aspect).drop("l1_", "l2_")
    return d.withColumn("cov", inverse(F.col("pxx"), F.col("pxy"), F.col("pyy"), 1e-40)).where("cov is not null")


def touch_points(frames: DataFrame, carry: tuple[str, ...] = (), timed: bool = False) -> DataFrame:
    """Dense frames (f, w, h, px) to f, touch_id, confidence, scale, mean, cov: the whole pipeline in one pass, without an exchange. Columns named in carry go along, first.

    timed: the same run also gives rows with `stage`, `n` (frames) and `us` (microseconds), one for each batch and stage, and
    nothing else; contacts have nulls there. `metrics.observed_stages` sums them while the contacts are written.
    """
    ship_package(frames.sparkSession)
    names = ["f", "touch_id", "confidence", "scale", "mean_x", "mean_y", "cov_xx", "cov_xy", "cov_yy"]
    types = [pa.int64(), pa.int32(), *[pa.float64()] * 7]
    told = [("stage", pa.string()), ("n", pa.int64()), ("us", pa.float64())] if timed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, source = batch.column("f").to_pylist(), [], []
            laps = []
            for places, (px,) in stacks(batch, ["px"], STACK):
                lap = dense.Laps()
                for place, points in zip(places, dense.touch_points(px, lap=lap), strict=True):
                    rows += [(ids[place], i, *p) for i, p in enumerate(points)]
                    source += [place] * len(points)
                laps += [(stage, len(px), us) for stage, us in lap.us.items()] if timed else []
            rows, source = rows + [(None,) * len(names)] * len(laps), source + [None] * len(laps)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kept = [batch.column(c).take(pa.array(source, pa.int64())) for c in carry]
            of_laps = [pa.array([None] * (len(rows) - len(laps)) + [x[k] for x in laps], t) for k, (_, t) in enumerate(told)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True)), *of_laps], names=[*carry, *names, *(c for c, _ in told)])

    given = frames.select(*carry, F.col("f").cast("long").alias("f"), "w", "h", F.col("px").cast("array<double>").alias("px"))
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in carry), "f long, touch_id int", *(f"{n} double" for n in names[2:]), *(["stage string, n long, us double"] if timed else [])])
    flat = given.mapInArrow(run, schema)
    return flat.select(*carry, "f", "touch_id", "confidence", "scale", F.struct(F.col("mean_x").alias("x"), F.col("mean_y").alias("y")).alias("mean"), F.struct(F.col("cov_xx").alias("xx"), F.col("cov_xy").alias("xy"), F.col("cov_yy").alias("yy")).alias("cov"), *(c for c, _ in told))
