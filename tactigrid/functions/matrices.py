"""Two-vectors and symmetric 2x2 matrices as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-20


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def norm(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def det(xx: Column, xy: Column, yy: Column) -> Column:
    return xx * yy - xy * xy


def trace(xx: Column, yy: Column) -> Column:
    return xx + yy


def quadratic_form(xx: Column, xy: Column, yy: Column, x: Column, y: Column) -> Column:
    return xx * x * x + 2 * xy * x * y + yy * y * y


def inverse(xx: Column, xy: Column, yy: Column, eps: float = EPS) -> Column:
    """struct(xx, xy, yy), or null for a singular matrix."""
    d = det(xx, xy, yy)
    return F.when(F.abs(d) > eps, F.struct((yy / d).alias("xx"), (-xy / d).alias("xy"), (xx / d).alias("yy")))


def larger_root(tr: Column, d: Column, eps: float = EPS) -> Column:
    """Root of r^2 - tr r + d that is larger in magnitude; rounding below zero under the root counts as zero."""
    root = F.sqrt(F.greatest(tr * tr - 4 * d, F.lit(0.0)))
    return F.when(F.abs(d) <= eps, tr.cast("double")).otherwise((tr + F.when(tr >= 0, root).otherwise(-root)) / 2)


def smaller_root(tr: Column, d: Column, first: Column, eps: float = EPS) -> Column:
    return F.when((F.abs(d) <= eps) | (first == 0), F.lit(0.0)).otherwise(d / first)


def quadratic_roots(a: Column, b: Column, c: Column, eps: float = EPS) -> tuple[Column, Column]:
    """Real roots of a r^2 + b r + c, the larger in magnitude first; one root twice where a is (nearly) 0, nulls where there is none."""
    root = F.sqrt(b * b - 4 * a * c)
    q = -(b + F.when(b >= 0, root).otherwise(-root)) / 2
    line = F.when(F.abs(b) > eps, -c / b)
    real, curved = b * b - 4 * a * c >= 0, F.abs(a) > eps
    first = F.when(curved & real, q / a).when(~curved, line)
    second = F.when(curved & real, F.when(F.abs(q) > eps, c / q).otherwise(0.0)).when(~curved, line)
    return first, second


def packed(scale: Column, mx: Column, my: Column, pxx: Column, pxy: Column, pyy: Column) -> Column:
    """Scale, mean and the four elements of the precision as one array of 7."""
    return F.array(scale, mx, my, pxx, pxy, pxy, pyy)


def unpacked(vector: Column) -> Column:
    """struct(scale, mx, my, pxx, pxy, pyy) of an array of 7; the two off-diagonal elements are averaged."""
    at = lambda i: F.element_at(vector, i + 1)
    return F.struct(at(0).alias("scale"), at(1).alias("mx"), at(2).alias("my"), at(3).alias("pxx"), ((at(4) + at(5)) / 2).alias("pxy"), at(6).alias("pyy"))


def eigenvalues(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    first = larger_root(trace(xx, yy), det(xx, xy, yy))
    return first, smaller_root(trace(xx, yy), det(xx, xy, yy), first)


def eigenvector(xx: Column, xy: Column, yy: Column, value: Column) -> tuple[Column, Column]:
    """Unit vector from the better conditioned row; (1, 0) for a multiple of the identity."""
    by_x = F.abs(xx - value) > F.abs(yy - value)
    x, y = F.when(by_x, -xy).otherwise(yy - value), F.when(by_x, xx - value).otherwise(-xy)
    size = F.hypot(x, y)
    return F.when(size > 0, x / size).otherwise(1.0), F.when(size > 0, y / size).otherwise(0.0)


def coherence(e1: Column, e2: Column) -> Column:
    return F.when(e1 + e2 != 0, (e1 - e2) / (e1 + e2)).otherwise(1.0)


def ridge(e1: Column, e2: Column) -> Column:
    return F.greatest(e1, F.lit(0.0)) + F.greatest(e2, F.lit(0.0))


def rotation_norm(e1: Column, e2: Column) -> Column:
    """|e1 e2| / (|e1| + |e2|), 0 if both are."""
    total = F.abs(e1) + F.abs(e2)
    return F.when(total > 0, F.abs(e1 * e2) / total).otherwise(0.0)


def logistic(x: Column, centre: float, spread: float, coverage: float) -> Column:
    """1 / (1 + exp(-a x + b)), which covers `coverage` of its range within spread of the centre."""
    a = math.log(-(coverage + 1) / (coverage - 1)) / spread
    return 1 / (1 + F.exp(-a * x + a * centre))


def gaussian_like(xx: Column, xy: Column, yy: Column, x: Column, y: Column) -> Column:
    return F.exp(-quadratic_form(xx, xy, yy, x, y) / 2)


def covariance(angle: Column, h: Column, w: Column) -> tuple[Column, Column, Column]:
    """Extents h along the angle and w across it."""
    c, s = F.cos(angle), F.sin(angle)
    return h * c * c + w * s * s, (h - w) * c * s, h * s * s + w * c * c


def pen_down(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(3)) == 3
