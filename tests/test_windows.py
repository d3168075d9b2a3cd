"""Fits of dense frames in arrays: the same as in columns, without a row for each cell."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactigrid.operators import fit, stencil, windows
from tactigrid.plans import catalogue
from tactigrid.sources import frames

RNG = np.random.default_rng(7)
FIT = ["f", "c", *fit.PARAMETERS]
#: Those that are made of dense frames.
QUERIES = ["fit_multi", "fit_one_iteration", "fit_recentred", "fit_unweighted", "normal_equations", "fit_accepted", "responsibilities"]


@pytest.fixture(scope="module")
def dense(spark):
    """Maxima at edges and corners, windows over each other, plateaus, a cell that is no number, small frames, and one without a number."""
    flat, odd = np.zeros((12, 20)), RNG.random((12, 20))
    flat[4:6, 7:9] = flat[0, 0] = 1.0
    odd[6, 9] = odd[6, 10] = np.nan
    made = [RNG.random((12, 20)), RNG.random((12, 20)) ** 8, flat, odd, np.ones((1, 1)), RNG.random((1, 9)), np.zeros((3, 4))]
    rows = [(i, a.shape[1], a.shape[0], [float(v) for v in a.ravel()]) for i, a in enumerate(made)]
    return spark.createDataFrame([*rows, (None, *rows[0][1:])], "f long, w int, h int, px array<double>").cache()


def same(one, other, columns):
    got, want = ({tuple(r[:n]): r[n:] for r in df.select(columns).collect()} for df in (one, other) for n in [len([c for c in columns if c in ("f", "c", "x", "y")])])
    assert got.keys() == want.keys() and len(got) > 20
    keys = list(want)
    assert np.allclose([got[k] for k in keys], [want[k] for k in keys], rtol=1e-6, atol=1e-8, equal_nan=True)


def test_fits_of_dense_frames_are_those_of_columns(dense):
    pixels = frames.to_long(dense)
    peaks = stencil.local_maxima(pixels, "v", 0.3)
    shared = fit.responsibilities(fit.window_pixels(fit.candidates(peaks), pixels))
    same(windows.responsibilities(dense, 0.3), shared, ["f", "c", "x", "y", "share"])
    same(windows.normal_equations(dense, 0.3), fit.normal_equations(shared), ["f", "c", *catalogue._EQUATION_COLUMNS])
    # In fewer of the systems than all rounding decides; these have clear pivots in both.
    clear = lambda d: d.where(F.abs(F.log("scale")) < 10).where(F.hypot("mx", "my") < 100)
    same(clear(windows.iterate(dense, 0.3)), clear(fit.in_pixels(fit.iterate(fit.candidates(peaks), pixels))), FIT)
    for weighted in (True, False):
        same(windows.fit_multi(dense, 0.3, 1, 3, weighted), fit.refit(fit.starts(peaks), pixels, 3, weighted), FIT)
    same(windows.fit_multi(dense, 0.3, 2, 3), fit.fit_multi(fit.starts(peaks), pixels, 2, 3), FIT)


def test_fits_whose_scale_no_double_holds_tell_its_logarithm(spark):
    """One maximum in a corner, with the Gaussian's mean, or a saddle's middle, far outside: scales of e^1250 and e^-1250."""
    y, x = np.mgrid[:12, :20]
    made = [np.exp(sign * (1250 - 1e-4 * (x + sign * 5000.0) ** 2 / 2) - 0.2 * y * y / 2) for sign in (1, -1)]
    stack = spark.createDataFrame([(i, 20, 12, [float(v) for v in a.ravel()]) for i, a in enumerate(made)], "f long, w int, h int, px array<double>")
    want = [(0, 0, 1250.0, -5000.0, 0.0, 1e-4, 0.0, 0.2), (1, 0, -1250.0, 5000.0, 0.0, -1e-4, 0.0, 0.2)]
    pixels = frames.to_long(stack)
    peaks = stencil.local_maxima(pixels, "v", 0.3)
    one, columns = windows.iterate(stack, 0.3), fit.in_pixels(fit.iterate(fit.candidates(peaks), pixels))
    told = {r["f"]: r["log_scale"] for r in one.select("f", *catalogue._fit_columns(one)).collect()}
    assert told.keys() == {0, 1} and np.allclose([told[0], told[1]], [1250, -1250], rtol=1e-4)
    refits = [made for weighted in (True, False) for made in (windows.fit_multi(stack, 0.3, 1, 3, weighted), fit.refit(fit.starts(peaks), pixels, 3, weighted))]
    for found, rows in [(one, want), (columns, want), *((made, want[:1]) for made in refits)]:  # a saddle is no refit
        got = sorted(found.select("f", "c", "log_scale", "mx", "my", "pxx", "pxy", "pyy").collect())
        assert len(got) == len(rows) and np.allclose(got, rows, rtol=1e-4, atol=1e-4)
    # The next round goes on without the infinite one.
    again = fit.iterate(fit.iterate(fit.candidates(peaks), pixels), pixels)
    assert {r["f"] for r in again.select("f").collect()} <= {1}


def test_windows_are_worked_on_so_many_at_a_time(monkeypatch):
    stack = RNG.random((3, 12, 20))
    frame, x, y = windows._maxima(stack, 0.3)
    told = {}
    for most in (4, 10**6):
        monkeypatch.setattr(windows, "WINDOWS", most)
        parts = list(windows._shared(stack, frame, x, y, 5, windows._unit_gaussian(x, y), True))
        assert len(parts) == max(1, math.ceil(len(frame) / most)) and len(parts[0][1]) <= most
        told[most] = np.concatenate([p[-1] for p in parts])
    assert len(frame) > 8 and np.allclose(told[4], told[10**6])


@pytest.mark.parametrize("name", QUERIES)
def test_queries_of_fits_make_no_rows_of_cells(spark, name):
    """Contacts are dealt by place and by frame; cells, a hundred times as many, are neither exploded, joined, sorted nor sent anywhere."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(step in plan for step in ("Join", "Generate", "Window", "Broadcast"))
