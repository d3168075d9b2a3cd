"""Moments and mixtures of dense frames in arrays: the same as in columns, without a row for each cell."""

import numpy as np
import pytest

from tactigrid.operators import mixture, moments
from tactigrid.plans import catalogue
from tactigrid.sources import frames

RNG = np.random.default_rng(11)
PARAMS = "f long, k int, mx double, my double, cxx double, cxy double, cyy double"
MEANS = ["f", "mean_x", "mean_y", "cov_xx", "cov_xy", "cov_yy"]


@pytest.fixture(scope="module")
def dense(spark):
    """Several sizes, frames without weight, one with a cell that is no number, and one without a number of its own."""
    odd, dot = RNG.random((12, 20)), np.zeros((12, 20))
    odd[6, 9], dot[3, 4] = np.nan, 2.0
    made = [RNG.random((12, 20)), RNG.random((12, 20)) ** 8, odd, dot, np.zeros((12, 20)), np.ones((1, 1)), RNG.random((1, 9)), RNG.random((12, 20))]
    rows = [(i, a.shape[1], a.shape[0], [float(v) for v in a.ravel()]) for i, a in enumerate(made)]
    return spark.createDataFrame([*rows, (None, *rows[0][1:])], "f long, w int, h int, px array<double>").cache()


@pytest.fixture(scope="module")
def params(spark):
    """From one to ten components a frame, not in order, equal ones among them, and one far off; frame 7 has none, and 99 is no frame."""
    rows = [(f, k, float(x), float(y), 9.0 + k, 1.0, 6.0) for f, n in ((0, 2), (1, 10), (2, 3), (3, 2), (4, 2), (5, 1), (6, 2), (99, 1)) for k, x, y in ((k, RNG.integers(0, 20), RNG.integers(0, 12)) for k in reversed(range(n)))]
    return spark.createDataFrame([*rows, (0, 7, *rows[0][2:]), (0, 6, *rows[0][2:]), (1, 20, 900.0, 900.0, 9.0, 0.0, 9.0)], PARAMS)


def same(one, other, keys):
    got, want = ({tuple(r[:keys]): r[keys:] for r in df.collect() if r[0] is not None} for df in (one, other))
    assert got.keys() == want.keys() and len(got) > 5
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-8, atol=1e-8, equal_nan=True)


def test_moments_of_dense_frames_are_those_of_columns(dense):
    same(moments.mean_and_covariance(dense).select(MEANS), mixture.mean_and_covariance(frames.to_long(dense)).select(MEANS), 1)


@pytest.mark.parametrize("hard", [True, False])
def test_mixtures_of_dense_frames_are_those_of_columns(dense, params, hard):
    pixels = frames.to_long(dense)
    along = lambda own: dense.join(own, "f")
    same(moments.mixture_step(along(moments.components(params)), hard), mixture.mixture_step(pixels, params, hard), 2)
    two = params.where("f in (0, 2) and k < 2")
    for got, want in zip(moments.mixture_rounds(along, two, 2, hard), mixture.mixture_rounds(pixels.where("f in (0, 2)"), two, 2, hard), strict=True):
        assert got.schema["k"].dataType == want.schema["k"].dataType
        got, want = (sorted(map(tuple, df.collect())) for df in (got, want))
        assert len(got) == len(want) >= 3 and np.allclose(np.array(got, float), np.array(want, float), rtol=1e-8, atol=1e-8, equal_nan=True)


def _plan(spark, name):
    return catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mle_mean_cov", "ellipse_geometry", "overlay_segments"])
def test_moments_make_no_rows_of_cells(spark, name):
    plan = _plan(spark, name)
    assert "MapInArrow" in plan and not any(step in plan for step in ("posexplode", "Join", "Window", "Broadcast"))


@pytest.mark.parametrize("name", ["mixture_hard", "mixture_soft"])
def test_mixtures_make_no_rows_of_cells_and_deal_no_grids(spark, name):
    """Parameters are joined with contacts, before the grids are made; these stay where they are."""
    plan = _plan(spark, name)
    above = plan[: plan.index("ArrowEvalPython")]
    assert "MapInArrow" in above and not any(step in above for step in ("posexplode", "Join", "Exchange")) and "BroadcastExchange" not in plan


def test_errors_of_rounds_are_joined_by_sorting(spark):
    plan = _plan(spark, "mixture_errors")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
