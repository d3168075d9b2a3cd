"""Joint Gaussian fits of the maxima of dense frames, in arrays: the same as the columns of `fit`, for frames that a task can hold.

Windows, shares and sums are made where a frame's cells are: no cell becomes a row, and nothing is joined, sorted or dealt.
All windows of a stack of frames are one array; they are worked on so many at a time, so that memory doesn't follow their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from tactigrid.operators import dense
from tactigrid.operators.batches import Columns, rows_of_frames
from tactigrid.operators.fit import LOG_EPS, MOMENTS, PARAMETERS, RIGHTS, gaussians

#: Windows that are worked on at a time.
WINDOWS = 4096
#: Means farther out are as good as there: their windows have no cell.
_OUT = 1e9


def _maxima(stack: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame, x and y of the maxima, in raster order; as in columns, a value that is no number is above all others."""
    frame, y, x = np.nonzero(dense.local_maxima(np.where(np.isnan(stack), np.inf, stack), threshold))
    return frame, x, y


def _shared(stack: np.ndarray, frame: np.ndarray, px: np.ndarray, py: np.ndarray, half: int, density: Callable, alone: bool) -> Iterator[tuple]:
    """(slice of the windows, x, y, whether inside, value, share) of the cells around px, py, for some windows at a time.

    Share: the density over the sum of all windows at the cell; where that isn't above zero, the density itself if alone, else 0 where it is zero.
    """
    n, h, w = stack.shape
    values, near = np.append(stack.ravel(), 0.0), np.arange(-half, half + 1)
    total = np.zeros(values.size)  # the last stands for all cells outside
    parts = [slice(low, low + WINDOWS) for low in range(0, len(frame), WINDOWS)]

    def cells(part: slice) -> tuple:
        x, y = px[part, None, None] + near, py[part, None, None] + near[:, None]
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        return x, y, inside, np.where(inside, (frame[part, None, None] * h + y) * w + x, n * h * w), density(part, x, y)

    for part in parts:
        *_, cell, g = cells(part)
        total += np.bincount(cell.ravel(), g.ravel(), total.size)
    with np.errstate(all="ignore"):
        for part in parts:
            x, y, inside, cell, g = cells(part)
            t = total[cell]
            yield part, x, y, inside, values[cell], np.where(t > 0, g / t, g) if alone else np.where(t != 0, g / t, 0.0)


def _sums(x: np.ndarray, y: np.ndarray, inside: np.ndarray, d: np.ndarray, centre: tuple, unit: tuple, weighted: bool, least: float | None) -> Columns:
    """The moments and right sides of `fit.normal_equations`, first summed along x and then along y; `n` is the number of cells."""
    used = inside if least is None else inside & ~(d < least)
    with np.errstate(all="ignore"):
        weight = np.where(used, d * d if weighted else 1.0, 0.0)
        arg = d + (LOG_EPS if least is None else 0.0)
        logs = np.where(used & ~(arg <= 0), weight * np.log(arg), 0.0)
    powers = []
    for at, c, u in ((x[:, 0, :], centre[0], unit[0]), (y[:, :, 0], centre[1], unit[1])):
        s = (at - c[:, None]) / u
        powers.append(np.stack([np.ones_like(s), s, s * s, s * s * s, s * s * s * s], -1))
    along, down = powers[0], powers[1].transpose(0, 2, 1)
    m, r = down @ (weight @ along), down[:, :3] @ (logs @ along[:, :, :3])
    return {**{f"m{i}{j}": m[:, j, i] for i, j in MOMENTS}, **{f"r{i}{j}": r[:, j, i] for i, j in RIGHTS}, "n": used.sum((1, 2))}


def _unit_gaussian(px: np.ndarray, py: np.ndarray) -> Callable:
    return lambda part, x, y: np.exp(-((x - px[part, None, None]) ** 2) / 2) * np.exp(-((y - py[part, None, None]) ** 2) / 2)


def _middle(p: np.ndarray, half: int, size: int) -> np.ndarray:
    """Of windows that are cut at the frame."""
    return (np.maximum(p - half, 0) + np.minimum(p + half, size - 1)) / 2


def responsibilities(frames: DataFrame, threshold: float, window: int = 11) -> DataFrame:
    """f, c, x, y, share of the cells of the maxima's windows; see `fit.responsibilities`."""
    half = (window - 1) // 2

    def run(stack: np.ndarray) -> Iterator[Columns]:
        frame, px, py = _maxima(stack, threshold)
        c = py * stack.shape[2] + px
        for part, x, y, inside, _, share in _shared(stack, frame, px, py, half, _unit_gaussian(px, py), True):
            own, row, column = np.nonzero(inside)
            yield {"frame": frame[part][own], "c": c[part][own], "x": x[own, 0, column].astype(np.int32), "y": y[own, row, 0].astype(np.int32), "share": share[inside]}

    return rows_of_frames(frames, run, {"c": "long", "x": "int", "y": "int", "share": "double"})


def normal_equations(frames: DataFrame, threshold: float, window: int = 11) -> DataFrame:
    """f, c, moments and right sides of the maxima's windows in the frame's coordinates in [-1, 1); see `fit.normal_equations`."""
    half = (window - 1) // 2

    def run(stack: np.ndarray) -> Iterator[Columns]:
        _, h, w = stack.shape
        frame, px, py = _maxima(stack, threshold)
        c, middle = py * w + px, (np.full(len(px), w / 2), np.full(len(px), h / 2))
        for part, x, y, inside, v, share in _shared(stack, frame, px, py, half, _unit_gaussian(px, py), True):
            sums = _sums(x, y, inside, v * share, (middle[0][part], middle[1][part]), (w / 2, h / 2), True, None)
            yield {"frame": frame[part], "c": c[part], **sums}

    return rows_of_frames(frames, run, {"c": "long", **{f"m{i}{j}": "double" for i, j in MOMENTS}, **{f"r{i}{j}": "double" for i, j in RIGHTS}})


def iterate(frames: DataFrame, threshold: float, window: int = 11, unit: float = 5.0) -> DataFrame:
    """One iteration from unit Gaussians at the maxima: f, c and PARAMETERS in pixels; see `fit.iterate`."""
    half = (window - 1) // 2

    def run(stack: np.ndarray) -> Iterator[Columns]:
        _, h, w = stack.shape
        frame, px, py = _maxima(stack, threshold)
        c, cx, cy = py * w + px, _middle(px, half, w), _middle(py, half, h)
        for part, x, y, inside, v, share in _shared(stack, frame, px, py, half, _unit_gaussian(px, py), True):
            centre = cx[part], cy[part]
            rows, found = gaussians(_sums(x, y, inside, v * share, centre, (unit, unit), True, None), centre, unit)
            yield {"frame": frame[part][rows], "c": c[part][rows], **found}

    return rows_of_frames(frames, run, {"c": "long", **dict.fromkeys(PARAMETERS, "double")})


def fit_multi(frames: DataFrame, threshold: float, rounds: int = 3, delta: int = 3, weighted: bool = True, least: float = 1e-20) -> DataFrame:
    """Rounds from unit Gaussians at the maxima whose windows follow the means: f, c and PARAMETERS in pixels; see `fit.refit`."""
    unit = float(max(1, delta))

    def run(stack: np.ndarray) -> Iterator[Columns]:
        _, h, w = stack.shape
        frame, x, y = _maxima(stack, threshold)
        ones, c = np.ones(len(x)), y * w + x
        own = dict(zip(PARAMETERS, (ones, x.astype(float), y.astype(float), ones, 0 * ones, ones, 0 * ones), strict=True))
        for _ in range(rounds):
            frame, c, own = _round(stack, frame, c, own)
        yield {"frame": frame, "c": c, **own}

    def _round(stack: np.ndarray, frame: np.ndarray, c: np.ndarray, own: Columns) -> tuple[np.ndarray, np.ndarray, Columns]:
        px, py = (np.rint(np.clip(own[k], -_OUT, _OUT)).astype(np.int64) for k in ("mx", "my"))

        def density(part: slice, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            mx, my, pxx, pxy, pyy = (own[k][part, None, None] for k in PARAMETERS[1:6])
            dx, dy = x - mx, y - my
            with np.errstate(all="ignore"):
                return np.sqrt(pxx * pyy - pxy * pxy) / (2 * math.pi) * np.exp(-(pxx * dx * dx + 2 * pxy * dx * dy + pyy * dy * dy) / 2)

        kept = []
        for part, x, y, inside, v, share in _shared(stack, frame, px, py, delta, density, False):
            centre = px[part].astype(float), py[part].astype(float)
            rows, found = gaussians(_sums(x, y, inside, v * share, centre, (unit, unit), weighted, least), centre, unit)
            with np.errstate(all="ignore"):
                rows_good = (found["pxx"] * found["pyy"] - found["pxy"] ** 2 > 0) & (found["pxx"] + found["pyy"] > 0)
            kept.append({"frame": frame[part][rows][rows_good], "c": c[part][rows][rows_good], **{k: a[rows_good] for k, a in found.items()}})
        if not kept:
            return frame, c, own
        frame, c, *found = (np.concatenate([k[name] for k in kept]) for name in ("frame", "c", *PARAMETERS))
        return frame, c, dict(zip(PARAMETERS, found, strict=True))

    return rows_of_frames(frames, run, {"c": "long", **dict.fromkeys(PARAMETERS, "double")})
