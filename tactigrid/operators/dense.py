"""Batches of dense frames as numpy arrays (frames, rows, columns).

Only what columns can't express per pixel is needed here (labels, distances, least squares); the rest is here too so that
the whole pipeline can run in one pass over dense frames, without an exchange.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np

from tactigrid.functions import kernels

EPS32, EPS64 = 1e-20, 1e-40
FAR = np.inf


def shifted(a: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    """out[y, x] = a[y + dy, x + dx], fill outside."""
    out = np.full_like(a, fill)
    h, w = a.shape[-2:]
    if abs(dy) < h and abs(dx) < w:
        out[..., max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[..., max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def correlate(a: np.ndarray, factors: kernels.Factors, border: str) -> np.ndarray:
    """Separable correlation; border extend or zero."""
    for axis, factor in ((-1, factors[0]), (-2, factors[1])):
        half = (len(factor) - 1) // 2
        pads = [(0, 0)] * a.ndim
        pads[axis % a.ndim] = (half, half)
        wide = np.pad(a, pads, mode="edge" if border == "extend" else "constant")
        n = a.shape[axis]
        a = sum(k * np.take(wide, range(i, i + n), axis) for i, k in enumerate(factor) if k)
    return a


def eigenvalues(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tr, det = xx + yy, xx * yy - xy * xy
    root = np.sqrt(np.maximum(tr * tr - 4 * det, 0))
    first = np.where(np.abs(det) <= EPS32, tr, (tr + np.where(tr >= 0, root, -root)) / 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return first, np.where((np.abs(det) <= EPS32) | (first == 0), 0.0, det / first)


def labels(mask: np.ndarray, connectivity: int = 4, down: int = 1) -> np.ndarray:
    """1..n per frame, in raster order of each component's first pixel; 0 is background.

    down = 2 is the flood fill that steps over the next row: a component is then what its first pixel reaches.
    """
    n, h, w = mask.shape
    none = h * w
    own = np.broadcast_to(np.arange(none).reshape(1, h, w), mask.shape)
    root = np.where(mask, own, none)
    steps = [(-down, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else [])
    while True:
        low = root
        for dy, dx in steps:
            low = np.minimum(low, shifted(root, dy, dx, none))
        low = np.where(mask, low, none)
        flat = np.concatenate([low.reshape(n, -1), np.full((n, 1), none)], 1)
        low = np.take_along_axis(flat, flat, 1)[:, :none].reshape(mask.shape)  # a root's own root
        if (low == root).all():
            break
        root = low
    rank = np.cumsum((root == own).reshape(n, -1), 1)
    rank = np.concatenate([rank, np.zeros((n, 1), rank.dtype)], 1)
    return np.take_along_axis(rank, root.reshape(n, -1), 1).reshape(mask.shape)


def local_maxima(a: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of 8-neighbour maxima; of equal neighbours the first in raster order."""
    found = a > threshold
    for dy, dx in ((0, -1), (-1, -1), (-1, 0), (-1, 1)):
        found &= a > shifted(a, dy, dx, -np.inf)
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        found &= a >= shifted(a, dy, dx, -np.inf)
    return found


def distances(source: np.ndarray, mask: np.ndarray, cost: np.ndarray, limit: float, step: float = 0.1, connectivity: int = 4) -> np.ndarray:
    """Least sum of (cost of the pixel left + step * length) from a source, over paths in the mask, if below limit."""
    d = np.where(source, 0.0, FAR)
    open_ = mask & ~source
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else [])
    while True:
        left = d + cost
        low = np.minimum.reduce([shifted(left, dy, dx, FAR) + step * (2**0.5 if dy and dx else 1.0) for dy, dx in near])
        better = open_ & (low < d) & (low < limit)
        if not better.any():
            return d
        d = np.where(better, low, d)


def component_scores(lab: np.ndarray, value: np.ndarray, coherence: np.ndarray, maxima: np.ndarray) -> np.ndarray:
    """(frames, labels + 1) scores; column 0 is background."""
    n, top = len(lab), int(lab.max(initial=0)) + 1
    index = (np.arange(n)[:, None, None] * top + lab).ravel()
    total = lambda v: np.bincount(index, v.ravel(), n * top).reshape(n, top)
    size, mixed, peaks = total(np.ones_like(value)), total(1 - coherence**2), total(maxima.astype(float))
    alpha = lambda spread, cover: -np.log((1 - cover) / (1 + cover)) / spread
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        by_size = 1 - 1 / (1 + np.exp(-alpha(15.0, 0.9) * (size - 40.0)))
        by_mix = 1 / (1 + np.exp(-alpha(0.3, 0.9) * (mixed / size - 0.4)))
    out = np.where((peaks > 0) & (size > 0), by_size * by_mix, 0.0)
    out[:, 0] = 0
    return out


def fit_gaussians(data: np.ndarray, peaks: list[tuple[int, int]], window: int = 11, rounds: int = 3) -> list[tuple[float, np.ndarray, np.ndarray] | None]:
    """(scale, mean (x, y), precision 2x2) of each peak (x, y) of one frame, None where a fit failed; all peaks are fitted jointly.

    All windows are one array, and all systems are solved at once. A window's coordinates are taken from its peak, in units
    of its half size: the solution is the same in any, and these keep the systems well conditioned.
    """
    h, w = data.shape
    half = (window - 1) // 2
    at = np.array(peaks, float)
    near = np.arange(-half, half + 1)
    dy, dx = (g.ravel() for g in np.meshgrid(near, near, indexing="ij"))
    x, y = np.array(peaks)[:, :1] + dx, np.array(peaks)[:, 1:] + dy
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    cell = np.where(inside, y * w + x, 0)
    value = np.where(inside, data.ravel()[cell], 0.0)
    u, v = dx / half, dy / half
    phi = np.stack([u * u, 2 * u * v, v * v, u, v, np.ones_like(u)])
    # Parameters in window units: a peak's first guess is a unit Gaussian of pixels.
    scale, mean = np.ones(len(at)), np.zeros((len(at), 2))
    precision = np.tile(np.diag([half**2, half**2]).astype(float), (len(at), 1, 1))
    alive = np.ones(len(at), bool)
    for _ in range(rounds):
        own = np.flatnonzero(alive)
        if not len(own):
            break
        eu, ev = u - mean[own, :1], v - mean[own, 1:]
        p = precision[own]
        with np.errstate(over="ignore", invalid="ignore"):
            like = scale[own, None] * np.exp(-(p[:, 0, 0, None] * eu * eu + 2 * p[:, 0, 1, None] * eu * ev + p[:, 1, 1, None] * ev * ev) / 2)
        usable = np.isfinite(like).all(1)  # a fit that diverged is given up
        alive[own[~usable]] = False
        own, like = own[usable], np.where(inside[own[usable]], like[usable], 0.0)
        total = np.bincount(cell[own].ravel(), like.ravel(), h * w)[cell[own]]
        d = np.where(total > 0, like / np.where(total > 0, total, 1), like) * value[own]
        weight = d * d
        matrix = np.einsum("an,pn,bn->pab", phi, weight, phi)
        right = np.einsum("an,pn->pa", phi, weight * np.log(d + np.finfo(float).eps))
        usable, chi = solved(matrix, right)
        alive[own[~usable]] = False
        own = own[usable]
        p = -2 * np.stack([np.stack([chi[:, 0], chi[:, 1]], -1), np.stack([chi[:, 1], chi[:, 2]], -1)], -2)
        det = p[:, 0, 0] * p[:, 1, 1] - p[:, 0, 1] ** 2
        with np.errstate(all="ignore"):
            m = np.stack([p[:, 1, 1] * chi[:, 3] - p[:, 0, 1] * chi[:, 4], p[:, 0, 0] * chi[:, 4] - p[:, 0, 1] * chi[:, 3]], -1) / det[:, None]
            size = np.exp(chi[:, 5] + np.einsum("pa,pab,pb->p", m, p, m) / 2)
        good = (np.abs(det) > EPS64) & np.isfinite(size) & np.isfinite(m).all(1)
        alive[own[~good]] = False
        scale[own[good]], mean[own[good]], precision[own[good]] = size[good], m[good], p[good]
    return [(float(scale[i]), at[i] + mean[i] * half, precision[i] / half**2) if alive[i] else None for i in range(len(at))]


#: Least pivot of a regular system with a unit diagonal; rounding leaves some 1e-16 of a singular one's.
PIVOT = 1e-12


def solved(matrix: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the symmetric systems have a solution, their solutions), scaled to a unit diagonal and eliminated in order, all at once.

    Normal equations have no pivot below zero; one that is (nearly) zero tells that the cells don't determine the quadratic.
    """
    size = np.sqrt(np.maximum(np.einsum("nii->ni", matrix), 0))
    found = (size > 0).all(1) & np.isfinite(matrix).all((1, 2)) & np.isfinite(right).all(1)
    scale = size[found]
    a, b = matrix[found] / scale[:, :, None] / scale[:, None, :], right[found] / scale
    regular, n = np.ones(len(a), bool), matrix.shape[-1]
    with np.errstate(all="ignore"):
        for k in range(n):
            regular &= a[:, k, k] > PIVOT
            factor = a[:, k + 1 :, k] / a[:, k, k, None]
            b[:, k + 1 :] -= factor * b[:, k, None]
            a[:, k + 1 :, k:] -= factor[:, :, None] * a[:, k, None, k:]
        chi = np.zeros_like(b)
        for k in range(n - 1, -1, -1):
            chi[:, k] = (b[:, k] - (a[:, k, k + 1 :] * chi[:, k + 1 :]).sum(1)) / a[:, k, k]
        chi /= scale
    regular &= np.isfinite(chi).all(1)
    found[np.flatnonzero(found)[~regular]] = False
    return found, chi[regular]


#: Of the contact pipeline, in order; `total` holds all.
STAGES = ("preprocessing", "structure-tensor", "structure-tensor.eigenvalues", "hessian", "ridge", "objective", "objective.maximas", "labels", "component-score", "distance-transform", "filter", "filter.maximas", "gaussian-fitting", "total")


class Laps:
    """Microseconds of each stage, for one batch of frames."""

    def __init__(self) -> None:
        self.begun = self.last = time.perf_counter()
        self.us: dict[str, float] = {}

    def __call__(self, stage: str) -> None:
        now = time.perf_counter()
        self.us[stage] = self.us.get(stage, 0.0) + (now - self.last) * 1e6
        self.last = now
        self.us["total"] = (now - self.begun) * 1e6


def touch_points(frames: np.ndarray, include: float = 0.6, limit: float = 6.0, peak: float = 0.05, max_aspect: float = 2.0, lap: Callable[[str], None] = lambda stage: None) -> list[list[tuple[float, float, float, float, float, float, float]]]:
    """Per frame: (confidence, scale, mean x, mean y, cov xx, xy, yy) of the accepted contacts. lap is called at the end of each stage."""
    v = correlate(frames, kernels.gaussian(5, 0.9), "extend")
    v = np.maximum(v - v.mean((1, 2), keepdims=True), 0)
    lap("preprocessing")
    gx, gy = correlate(v, kernels.SOBEL_X, "zero"), correlate(v, kernels.SOBEL_Y, "zero")
    soft = kernels.gaussian(5, 1.0)
    tensor = [correlate(t, soft, "extend") for t in (gx * gx, gx * gy, gy * gy)]
    lap("structure-tensor")
    e1, e2 = eigenvalues(*tensor)
    lap("structure-tensor.eigenvalues")
    second = [correlate(correlate(v, k, "zero"), soft, "extend") for k in (kernels.SOBEL_XX, kernels.SOBEL_XY, kernels.SOBEL_YY)]
    lap("hessian")
    k1, k2 = eigenvalues(*second)
    ridge = np.maximum(k1, 0) + np.maximum(k2, 0)
    lap("ridge")
    foreground = v - 1.5 * ridge > 0
    lap("objective")
    peaks_of_v = local_maxima(v, peak)
    lap("objective.maximas")
    lab = labels(foreground)
    lap("labels")
    with np.errstate(divide="ignore", invalid="ignore"):
        coherence = np.where(e1 + e2 != 0, (e1 - e2) / (e1 + e2), 1.0)
    score = component_scores(lab, v, coherence, peaks_of_v)
    lap("component-score")
    own = np.take_along_axis(score, lab.reshape(len(lab), -1), 1).reshape(lab.shape)
    cost, mask = 9 * ridge + np.maximum(e1, 0) + np.maximum(e2, 0), (v > 0) & (lab == 0)
    inside, outside = (distances((lab > 0) & chosen, mask, cost, limit) for chosen in (own > include, own <= include))
    lap("distance-transform")
    wi, we = np.exp(-(inside**2)), np.exp(-(outside**2))
    total = wi + we
    filtered = v * np.where(total > 0, wi / np.where(total > 0, total, 1), 0.0)
    lap("filter")
    found = local_maxima(filtered, peak)
    lap("filter.maximas")
    out = []
    for i in range(len(frames)):
        peaks = [(int(x), int(y)) for y, x in np.argwhere(found[i])]
        points = []
        for fit in fit_gaussians(filtered[i], peaks) if peaks else []:
            if fit is None:
                continue
            scale, mean, precision = fit
            det = precision[0, 0] * precision[1, 1] - precision[0, 1] ** 2
            if abs(det) <= EPS64:
                continue
            cov = np.array([[precision[1, 1], -precision[0, 1]], [-precision[0, 1], precision[0, 0]]]) / det
            sizes = np.sqrt(np.abs(np.linalg.eigvalsh(cov)))
            if sizes.min() <= EPS32 or sizes.max() / sizes.min() > max_aspect:
                continue
            x, y = (int(min(max(m, -1e9), 1e9)) for m in mean)
            x, y = min(max(x, 0), lab.shape[2] - 1), min(max(y, 0), lab.shape[1] - 1)
            points.append((float(score[i, lab[i, y, x]]), scale, float(mean[0]), float(mean[1]), float(cov[0, 0]), float(cov[0, 1]), float(cov[1, 1])))
        out.append(points)
    lap("gaussian-fitting")
    return out
