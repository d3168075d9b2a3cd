"""Stencil kernels: pairs of 1-D factors (along x, along y), or a whole matrix; all kernels of the engine itself are separable."""

from __future__ import annotations

import math

Factors = tuple[list[float], list[float]]
#: Rows (along y) of weights (along x); both counts are odd.
Matrix = list[list[float]]


def rows_of(kernel: Factors | Matrix) -> Matrix | None:
    """The rows of a matrix, None for factors."""
    if isinstance(kernel, tuple):
        return None
    if not kernel or len(kernel) % 2 == 0 or len(kernel[0]) % 2 == 0 or any(len(r) != len(kernel[0]) for r in kernel):
        raise ValueError("a kernel needs rows of one odd length, and an odd number of them")
    return kernel


def gaussian_factor(size: int, sigma: float) -> list[float]:
    """exp(-(d / sigma)^2 / 2), normalised to sum 1."""
    half = (size - 1) // 2
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-half, size - half)]
    return [v / sum(raw) for v in raw]


def gaussian(size: int, sigma: float) -> Factors:
    return gaussian_factor(size, sigma), gaussian_factor(size, sigma)


def truncated_gaussian(sigma: float, truncate: float = 4.0) -> Factors:
    """Cut at so many sigmas, as array libraries do."""
    size = 2 * int(truncate * sigma + 0.5) + 1
    return gaussian(size, sigma)


# First and second order Sobel factors, and the 5-tap ones of the wider second derivatives.
SOBEL_X: Factors = ([1, 0, -1], [1, 2, 1])
SOBEL_Y: Factors = ([1, 2, 1], [1, 0, -1])
SOBEL_XX: Factors = ([1, -2, 1], [1, 2, 1])
SOBEL_YY: Factors = ([1, 2, 1], [1, -2, 1])
SOBEL_XY: Factors = ([1, 0, -1], [1, 0, -1])
WIDE_XX: Factors = ([1, 0, -2, 0, 1], [1, 4, 6, 4, 1])
WIDE_YY: Factors = ([1, 4, 6, 4, 1], [1, 0, -2, 0, 1])
WIDE_XY: Factors = ([1, 2, 0, -2, -1], [1, 2, 0, -2, -1])
BINOMIAL_5: Factors = ([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
