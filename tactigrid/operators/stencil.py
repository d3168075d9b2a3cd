"""Neighbourhood operators over long pixel tables (f, x, y, w, h and measures).

A stencil is two passes of lag/lead windows, along x and then along y. Both window partitionings, (f, y) and
(f, x), are satisfied by one exchange on f, so a chain of stencils sorts but never shuffles again.

A kernel that is a whole matrix takes the same two passes: the first sums along x once for each of its rows, the second takes
each of these sums from its own distance along y. That is as many window functions as a separable kernel of that size has
(the sums share the taps), so a decomposition of the matrix into several separable kernels would never take fewer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions import kernels, matrices


#: Border policy -> policy along x, policy along y.
BORDERS = {"extend": ("extend", "extend"), "zero": ("zero", "zero"), "mirror": ("mirror", "mirror"), "mirror_x": ("mirror", "zero"), "mirror_y": ("zero", "mirror")}


def _row():
    return Window.partitionBy("f", "y").orderBy("x")


def _column():
    return Window.partitionBy("f", "x").orderBy("y")


@dataclass(frozen=True)
class Stencil:
    source: str
    target: str
    factors: kernels.Factors | kernels.Matrix


def _at(value: str, offset: int, window) -> Column:
    if offset == 0:
        return F.col(value)
    return F.lead(value, offset).over(window) if offset > 0 else F.lag(value, -offset).over(window)


def _tap(value: str, offset: int, window, border: str, place: str, size: str) -> Column:
    """The value at an offset, under a border policy."""
    inner = _at(value, offset, window)
    if offset == 0:
        return inner
    if border == "zero":
        return F.coalesce(inner, F.lit(0))
    if border == "extend":
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(inner, (F.last if offset > 0 else F.first)(value).over(whole))
    room = F.col(size) - F.col(place) if offset > 0 else F.col(place) + 1  # cells up to the edge, this one included
    mirrored = F.lit(None)
    for r in range(1, abs(offset) + 1):
        step = 2 * r - 1 - abs(offset)
        mirrored = F.when(room == r, _at(value, step if offset > 0 else -step, window)).otherwise(mirrored)
    return F.when(room > abs(offset), inner).otherwise(F.coalesce(mirrored, F.lit(0)))


#: Target, and its terms: column, offset, weight.
Job = tuple[str, list[tuple[str, int, float]]]


def _pass(df: DataFrame, jobs: Sequence[Job], window, border: str, place: str, size: str) -> DataFrame:
    made = []
    for target, terms in jobs:
        columns = [F.lit(k) * _tap(source, offset, window, border, place, size) for source, offset, k in terms]
        made.append(sum(columns[1:], columns[0]).alias(target) if columns else F.lit(0).alias(target))
    return df.select("*", *made)


def _along(source: str, factor: Sequence[float]) -> list[tuple[str, int, float]]:
    half = (len(factor) - 1) // 2
    return [(source, i - half, k) for i, k in enumerate(factor) if k]


def _jobs(s: Stencil) -> tuple[list[Job], Job]:
    """What a stencil needs of the pass along x, and of that along y."""
    rows = kernels.rows_of(s.factors)
    if rows is None:
        return [(f"{s.target}_x_", _along(s.source, s.factors[0]))], (f"{s.target}_y_", _along(f"{s.target}_x_", s.factors[1]))
    some = [(j, terms) for j, row in enumerate(rows) if (terms := _along(s.source, row))]
    half = (len(rows) - 1) // 2
    return [(f"{s.target}_x{j}_", terms) for j, terms in some], (f"{s.target}_y_", [(f"{s.target}_x{j}_", j - half, 1) for j, _ in some])


def convolve(df: DataFrame, stencils: Sequence[Stencil], border: str = "extend") -> DataFrame:
    """Adds the targets: correlations (kernels aren't flipped) of the sources. All share the two passes."""
    along_x, along_y = BORDERS[border]
    firsts, seconds = zip(*map(_jobs, stencils), strict=True)
    first = _pass(df, [job for jobs in firsts for job in jobs], _row(), along_x, "x", "w")
    second = _pass(first, seconds, _column(), along_y, "y", "h")
    targets = [s.target for s in stencils]
    return second.select(*(c for c in df.columns if c not in targets), *(F.col(f"{t}_y_").alias(t) for t in targets))


def smooth(df: DataFrame, columns: Sequence[str], sigma: float, size: int = 5, border: str = "extend") -> DataFrame:
    return convolve(df, [Stencil(c, c, kernels.gaussian(size, sigma)) for c in columns], border)


def remove_floor(df: DataFrame, column: str = "v") -> DataFrame:
    """max(v - average of the frame, 0)."""
    return df.withColumn(column, F.greatest(F.col(column) - F.avg(column).over(Window.partitionBy("f")), F.lit(0.0)))


def preprocess(df: DataFrame, sigma: float = 0.9, floor_first: bool = False) -> DataFrame:
    """Smoothing and removal of the noise floor, in either order."""
    return smooth(remove_floor(df), ["v"], sigma) if floor_first else remove_floor(smooth(df, ["v"], sigma))


def gradient(df: DataFrame, border: str = "zero") -> DataFrame:
    return convolve(df, [Stencil("v", "gx", kernels.SOBEL_X), Stencil("v", "gy", kernels.SOBEL_Y)], border)


def blur(df: DataFrame, columns: Sequence[str], sigma: float) -> DataFrame:
    """The smoothing of array libraries: cut at 4 sigmas, frames reflected at their edges."""
    return convolve(df, [Stencil(c, c, kernels.truncated_gaussian(sigma)) for c in columns], "mirror")


def structure_tensor(df: DataFrame, sigma: float | None = None, smoothing=None) -> DataFrame:
    """Adds sxx, sxy, syy, smoothed (by `smooth`, or another function of df, columns and sigma) if sigma is given."""
    g = gradient(df)
    t = g.select(*df.columns, (F.col("gx") * F.col("gx")).alias("sxx"), (F.col("gx") * F.col("gy")).alias("sxy"), (F.col("gy") * F.col("gy")).alias("syy"))
    return (smoothing or smooth)(t, ["sxx", "sxy", "syy"], sigma) if sigma else t


def hessian(df: DataFrame, sigma: float | None = None, border: str = "zero", wide: bool = False, smoothing=None) -> DataFrame:
    """Adds hxx, hxy, hyy, smoothed if sigma is given."""
    xx, xy, yy = (kernels.WIDE_XX, kernels.WIDE_XY, kernels.WIDE_YY) if wide else (kernels.SOBEL_XX, kernels.SOBEL_XY, kernels.SOBEL_YY)
    t = convolve(df, [Stencil("v", "hxx", xx), Stencil("v", "hxy", xy), Stencil("v", "hyy", yy)], border)
    return (smoothing or smooth)(t, ["hxx", "hxy", "hyy"], sigma) if sigma else t


def with_eigenvalues(df: DataFrame, prefix: str, first: str, second: str) -> DataFrame:
    """Adds the eigenvalues of the matrix in prefix+xx, +xy, +yy, the larger in magnitude first."""
    m = [F.col(prefix + k).cast("double") for k in ("xx", "xy", "yy")]
    d = df.withColumn("tr_", matrices.trace(m[0], m[2])).withColumn("det_", matrices.det(*m))
    d = d.withColumn(first, matrices.larger_root(F.col("tr_"), F.col("det_")))
    return d.withColumn(second, matrices.smaller_root(F.col("tr_"), F.col("det_"), F.col(first))).drop("tr_", "det_")


def measures(df: DataFrame, weight: float = 1.0, ridge_weight: float = 1.5) -> DataFrame:
    """From preprocessed pixels: e1, e2 (structure tensor), ridge, objective."""
    d = hessian(structure_tensor(df, 1.0), 1.0)
    d = with_eigenvalues(with_eigenvalues(d, "s", "e1", "e2"), "h", "k1", "k2")
    d = d.withColumn("ridge", matrices.ridge(F.col("k1"), F.col("k2")))
    return d.withColumn("objective", weight * F.col("v") - ridge_weight * F.col("ridge")).drop("sxx", "sxy", "syy", "hxx", "hxy", "hyy", "k1", "k2")


def powered_objective(v: Column, ridge: Column, wh: float = 1.0, ph: float = 1.0, wr: float = 1.0, pr: float = 1.0) -> Column:
    return wh * F.pow(v, F.lit(ph)) - wr * F.pow(ridge, F.lit(pr))


def local_maxima(df: DataFrame, column: str, threshold: float, connectivity: int = 8, ties: str = "first", inclusive: bool = False) -> DataFrame:
    """The pixels that are maxima, see `with_maxima`."""
    return with_maxima(df, column, threshold, connectivity, ties, inclusive).where("is_max").drop("is_max")


def strongest(maxima: DataFrame, n: int, column: str = "v") -> DataFrame:
    """The n strongest of each frame, the first in raster order of equal ones, with rank from 1. Tasks drop what can't be among them before any exchange."""
    order = Window.partitionBy("f").orderBy(F.desc(column), "y", "x")
    return maxima.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def with_maxima(df: DataFrame, column: str, threshold: float, connectivity: int = 8, ties: str = "first", inclusive: bool = False) -> DataFrame:
    """Adds is_max: whether a pixel is a maximum of its neighbourhood; cells outside the frame are ignored.

    ties: `first` keeps the first of equal neighbours in raster order, `last` the greatest (value, x, y), `all` every one.
    """
    d = df.select("*", F.lag(column).over(_row()).alias("left_"), F.lead(column).over(_row()).alias("right_"))
    line = F.struct(F.col("left_").alias("a"), F.col(column).alias("b"), F.col("right_").alias("c"))
    d = d.withColumn("line_", line).select("*", F.lag("line_").over(_column()).alias("up_"), F.lead("line_").over(_column()).alias("down_"))
    diagonal = ("a", "b", "c") if connectivity == 8 else ("b",)
    # Neighbours before and after a cell: by raster order (y, x), or by (x, y).
    before = [F.col("left_"), *(F.col("up_")[k] for k in diagonal)]
    after = [F.col("right_"), *(F.col("down_")[k] for k in diagonal)]
    if ties == "last":
        before = [F.col("left_"), F.col("up_")["b"]] + ([F.col("up_")["a"], F.col("down_")["a"]] if connectivity == 8 else [])
        after = [F.col("right_"), F.col("down_")["b"]] + ([F.col("up_")["c"], F.col("down_")["c"]] if connectivity == 8 else [])
    v = F.col(column)
    is_max = v >= threshold if inclusive else v > threshold
    for n in before:
        is_max &= F.coalesce(n < v if ties == "first" else n <= v, F.lit(True))
    for n in after:
        is_max &= F.coalesce(n < v if ties == "last" else n <= v, F.lit(True))
    return d.withColumn("is_max", is_max).drop("left_", "right_", "line_", "up_", "down_")
