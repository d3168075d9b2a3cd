"""Golden cases, properties and agreement of the two layouts."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tactigrid.functions import colour, kernels, matrices
from tactigrid.operators import components, dense, distance, fit, metrics, mixture, stencil, strokes
from tactigrid.sources import capture, frames

LONG = "f long, x int, y int, v double, w int, h int"


def pixels(spark, *arrays):
    rows = [(f, x, y, float(a[y, x]), a.shape[1], a.shape[0]) for f, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, LONG)


def image(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("x", "y", column).collect():
        out[r["y"], r["x"]] = r[column]
    return out


def bump(mean, cov, amplitude=1.0, shape=(48, 72)):
    y, x = np.mgrid[: shape[0], : shape[1]]
    p = np.linalg.inv(np.array(cov))
    dx, dy = x - mean[0], y - mean[1]
    return amplitude * np.exp(-(p[0, 0] * dx * dx + 2 * p[0, 1] * dx * dy + p[1, 1] * dy * dy) / 2)


RNG = np.random.default_rng(4)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (7, 1), (6, 9)])
def test_extend_and_zero_stencils_agree_with_arrays(spark, shape):
    a = RNG.normal(size=shape)
    for border in ("extend", "zero"):
        for factors in (kernels.gaussian(5, 0.9), kernels.SOBEL_XX):
            got = image(stencil.convolve(pixels(spark, a), [stencil.Stencil("v", "o", factors)], border), "o", shape)
            assert np.allclose(got, dense.correlate(a[None], factors, border)[0])


def test_mirror_reflects_including_the_edge(spark):
    a = np.arange(12.0).reshape(3, 4)
    wide = np.pad(a, 2, mode="symmetric")
    k = np.outer(kernels.BINOMIAL_5[1], kernels.BINOMIAL_5[0])
    want = [[(wide[y : y + 5, x : x + 5] * k).sum() for x in range(4)] for y in range(3)]
    assert np.allclose(image(stencil.convolve(pixels(spark, a), [stencil.Stencil("v", "o", kernels.BINOMIAL_5)], "mirror"), "o", (3, 4)), want)


PADDING = {"extend": ("edge", "edge"), "zero": ("constant", "constant"), "mirror": ("symmetric", "symmetric"), "mirror_x": ("symmetric", "constant"), "mirror_y": ("constant", "symmetric")}


@pytest.mark.parametrize("border", PADDING)
@pytest.mark.parametrize("shape", [(6, 9), (2, 4), (1, 1)])
def test_kernels_of_any_matrix(spark, border, shape):
    a, k = RNG.integers(-9, 9, shape).astype(float), RNG.integers(-4, 5, (5, 3)).astype(float)
    k[3] = 0
    assert np.linalg.matrix_rank(k) > 1
    wide = np.pad(np.pad(a, ((0, 0), (1, 1)), PADDING[border][0]), ((2, 2), (0, 0)), PADDING[border][1])
    if border in ("mirror", "mirror_y") and shape[0] < 2:  # what is further out than the frame is wide is 0
        wide[:1] = wide[-1:] = 0
    want = [[(wide[y : y + 5, x : x + 3] * k).sum() for x in range(shape[1])] for y in range(shape[0])]
    got = stencil.convolve(pixels(spark, a), [stencil.Stencil("v", "o", k.tolist()), stencil.Stencil("v", "p", [[2.0]])], border)
    assert np.allclose(image(got, "o", shape), want) and np.allclose(image(got, "p", shape), 2 * a)


def test_odd_kernels(spark):
    for bad in ([], [[1.0, 2.0]], [[1.0], [2.0]], [[1.0], [2.0, 3.0, 4.0], [5.0]]):
        with pytest.raises(ValueError, match="odd"):
            stencil.convolve(pixels(spark, np.eye(3)), [stencil.Stencil("v", "o", bad)])
    assert np.allclose(image(stencil.convolve(pixels(spark, np.eye(3)), [stencil.Stencil("v", "o", [[0.0] * 3] * 3)]), "o", (3, 3)), 0)
    text = stencil.convolve(frames.together(pixels(spark, np.eye(4))), [stencil.Stencil("v", "o", np.arange(25.0).reshape(5, 5).tolist())])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_strongest_maxima_of_a_frame(spark):
    a = np.zeros((9, 9))
    a[1, 1], a[1, 5], a[5, 1], a[5, 5], a[7, 7] = 3, 5, 5, 4, 1
    got = stencil.strongest(stencil.local_maxima(pixels(spark, a, a * 2), "v", 0.5), 3).where("f = 1").orderBy("rank").collect()
    assert [(r["x"], r["y"], r["v"]) for r in got] == [(5, 1, 10), (1, 5, 10), (5, 5, 8)]


def test_splats_have_a_partition_for_each_task(spark):
    """A few kB of contacts make megabytes of cells: adaptive execution mustn't put them into one partition."""
    contacts = spark.range(4000).select((F.col("id") % 97).alias("f"), "id", (F.col("id") * 7 % 72).cast("int").alias("mx"), (F.col("id") * 13 % 48).cast("int").alias("my"), F.lit(0.5).alias("amplitude"))
    made = frames.splat(contacts).select(F.spark_partition_id().alias("p")).distinct().count()
    assert made >= spark.sparkContext.defaultParallelism
    assert frames.splat(contacts, partitions=11).rdd.getNumPartitions() == 11


def test_components_are_measured_without_a_join(spark):
    from tactigrid.plans import catalogue

    text = catalogue.queries()["component_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1


def test_constant_frame_stays_and_has_no_floor(spark):
    a = np.full((5, 6), 3.0)
    assert np.allclose(image(stencil.smooth(pixels(spark, a), ["v"], 0.9), "v", a.shape), 3)
    assert np.allclose(image(stencil.preprocess(pixels(spark, a)), "v", a.shape), 0, atol=1e-12)


def test_stencils_add_no_exchange_to_the_first(spark):
    text = stencil.measures(stencil.preprocess(frames.together(pixels(spark, np.eye(4)))))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_plateau_ties(spark):
    a = np.zeros((48, 72))
    a[20:22, 20:22] = 1
    one = lambda ties: [(r["x"], r["y"]) for r in stencil.local_maxima(pixels(spark, a), "v", 0.5, ties=ties).collect()]
    assert one("first") == [(20, 20)]
    assert one("last") == [(21, 21)]
    assert len(one("all")) == 4
    assert np.argwhere(dense.local_maxima(a[None], 0.5)[0]).tolist() == [[20, 20]]


def test_labels_number_components_in_raster_order(spark):
    u = np.array([[1, 0, 1, 0, 0], [1, 0, 1, 0, 1], [1, 1, 1, 0, 0], [0, 0, 0, 1, 0]], float)
    four, eight = dense.labels(u[None] > 0, 4)[0], dense.labels(u[None] > 0, 8)[0]
    assert four.tolist() == [[1, 0, 1, 0, 0], [1, 0, 1, 0, 2], [1, 1, 1, 0, 0], [0, 0, 0, 3, 0]]
    assert eight.max() == 2 and eight[3, 3] == eight[0, 0]
    long = pixels(spark, u, np.zeros((2, 2)), np.ones((3, 3)))
    got = {(r["f"], r["x"], r["y"]): r["label"] for r in components.label_relational(long, 0.0, 4).collect()}
    want = {(r["f"], r["x"], r["y"]): r["label"] for r in components.label_pixels(frames.to_dense(long), 0.0, 4).where("label > 0").collect()}
    assert got == want and {v for (f, *_), v in want.items() if f == 2} == {1}


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 2**32 - 1))
def test_labels_are_components(h, w, seed):
    mask = np.random.default_rng(seed).random((1, h, w)) > 0.5
    lab = dense.labels(mask, 4)[0]
    assert ((lab > 0) == mask[0]).all()
    for y, x in np.argwhere(mask[0]):
        for b, a in ((y + 1, x), (y, x + 1)):
            if b < h and a < w and mask[0, b, a]:
                assert lab[y, x] == lab[b, a]
    firsts = [np.flatnonzero(lab.ravel() == k)[0] for k in range(1, lab.max() + 1)]
    assert firsts == sorted(firsts)


def test_distances_charge_the_pixel_that_is_left_and_variants_agree(spark):
    cost = RNG.random((6, 8)) * 0.5
    source = RNG.random((6, 8)) > 0.9
    source[0, 0] = True
    mask = (RNG.random((6, 8)) > 0.3) & ~source
    d = dense.distances(source[None], mask[None], cost[None], 1.5)[0]
    for y, x in np.argwhere(np.isfinite(d) & ~source):
        near = [d[b, a] + cost[b, a] + 0.1 for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= b < 6 and 0 <= a < 8]
        assert math.isclose(d[y, x], min(near)) and d[y, x] < 1.5
    rows = [(0, x, y, bool(source[y, x]), bool(mask[y, x]), float(cost[y, x])) for y in range(6) for x in range(8)]
    got = {(r["x"], r["y"]): r["distance"] for r in distance.distance_relational(spark.createDataFrame(rows, "f long, x int, y int, source boolean, mask boolean, cost double"), 1.5).collect()}
    assert got.keys() == {(x, y) for y, x in np.argwhere(np.isfinite(d))} and all(math.isclose(v, d[y, x], abs_tol=1e-12) for (x, y), v in got.items())
    flat = lambda a: [float(v) for v in a.ravel()]
    one = spark.createDataFrame([(0, 8, 6, flat(source), flat(mask), flat(cost))], "f long, w int, h int, source array<double>, mask array<double>, cost array<double>")
    assert [v is None for v in distance.distance_frames(one, 1.5).first()["distance"]] == [not v for v in np.isfinite(d).ravel()]


def test_soft_masks_sum_to_one_where_any_set_reaches(spark):
    rows = [(0, 0, 0, s, d) for s, d in ((0, 0.5), (1, 1.0), (2, None))] + [(0, 1, 0, s, None) for s in range(3)]
    d = distance.decomposition_weights(spark.createDataFrame(rows, "f long, x int, y int, set_id int, distance double"))
    assert [round(r["s"], 12) for r in d.groupBy("x").agg(F.sum("weight").alias("s")).orderBy("x").collect()] == [1.0, 0.0]


def test_matrices(spark):
    row = spark.createDataFrame([(3.0, 1.0, 2.0)], "xx double, xy double, yy double")
    m = [F.col(c) for c in ("xx", "xy", "yy")]
    e1, e2 = matrices.eigenvalues(*m)
    got = row.select(e1.alias("a"), e2.alias("b"), matrices.inverse(*m).alias("i"), matrices.quadratic_form(*m, F.lit(2.0), F.lit(-1.0)).alias("q")).first()
    want = np.linalg.eigvalsh([[3, 1], [1, 2]])
    assert np.allclose([got["b"], got["a"]], want) and np.isclose(got["i"]["xx"], 0.4) and got["q"] == 10
    assert row.select(matrices.inverse(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("i")).first()["i"] is None
    vx, vy = matrices.eigenvector(*m, e1)
    v = row.select(vx.alias("x"), vy.alias("y")).first()
    assert np.allclose(np.array([[3, 1], [1, 2]]) @ [v["x"], v["y"]], want[1] * np.array([v["x"], v["y"]]))


def test_fit_recovers_a_contact_and_two_overlapping_ones():
    cov = [[1.6, 0.4], [0.4, 1.3]]
    one = bump((15.3, 10.6), cov)
    (got,) = dense.fit_gaussians(one, [(15, 11)])
    assert np.allclose(got[1], (15.3, 10.6), atol=1e-3) and np.allclose(np.linalg.inv(got[2]), cov, atol=1e-3) and abs(got[0] - 1) < 1e-3
    two = bump((20.0, 20.0), np.eye(2)) + bump((25.0, 20.5), np.eye(2) * 1.3)
    found = dense.fit_gaussians(two, [(20, 20), (25, 20)], rounds=8)
    assert np.allclose(found[0][1], (20, 20), atol=0.1) and np.allclose(found[1][1], (25, 20.5), atol=0.1)


def test_one_iteration_in_columns_agrees_with_arrays(spark):
    a = bump((15.3, 10.6), [[1.6, 0.4], [0.4, 1.3]]) + bump((40.2, 30.1), np.eye(2) * 2)
    long = pixels(spark, a)
    peaks = stencil.local_maxima(long, "v", 0.3)
    got = {r["c"]: r for r in fit.in_pixels(fit.iterate(fit.candidates(peaks), long)).collect()}
    places = sorted((r["y"], r["x"]) for r in peaks.collect())
    for (y, x), want in zip(places, dense.fit_gaussians(a, [(x, y) for y, x in places], rounds=1), strict=True):
        r = got[y * 72 + x]
        assert np.allclose([r["scale"], r["mx"], r["my"], r["pxx"], r["pxy"], r["pyy"]], [want[0], *want[1], want[2][0, 0], want[2][0, 1], want[2][1, 1]], rtol=1e-6)


def test_pipeline_finds_contacts_and_survives_odd_frames(spark):
    a = bump((15.3, 10.6), np.eye(2) * 3) + bump((50.0, 30.0), np.eye(2) * 3)
    odd = [np.zeros((3, 4)), np.ones((3, 4)), np.ones((1, 1)), np.ones((1, 9))]
    rows = [(i, v.shape[1], v.shape[0], [float(x) for x in v.ravel()]) for i, v in enumerate([a, *odd])]
    got = fit.touch_points(spark.createDataFrame(rows, "f long, w int, h int, px array<double>")).collect()
    means = sorted((r["mean"]["x"], r["mean"]["y"]) for r in got if r["f"] == 0)
    assert np.allclose(means, [(15.3, 10.6), (50.0, 30.0)], atol=0.2) and {r["f"] for r in got} == {0}
    assert metrics.ellipses(fit.touch_points(spark.createDataFrame(rows[:1], "f long, w int, h int, px array<double>")), 48).count() == 2


def test_moments_mixture_and_bfgs(spark):
    a = bump((15.3, 10.6), [[1.6, 0.4], [0.4, 1.3]])
    m = mixture.mean_and_covariance(pixels(spark, a)).first()
    assert np.allclose([m["mean_x"], m["mean_y"], m["cov_xx"], m["cov_xy"], m["cov_yy"]], [15.3, 10.6, 1.6, 0.4, 1.3], atol=1e-3)
    two = pixels(spark, bump((20.0, 20.0), np.eye(2)) + bump((50.0, 30.0), np.eye(2)))
    start = spark.createDataFrame([(0, k, x, y, 40.0, 0.0, 40.0) for k, x, y in ((0, 15.0, 15.0), (1, 55.0, 35.0))], "f long, k int, mx double, my double, cxx double, cxy double, cyy double")
    for hard in (True, False):
        got = sorted((r["mx"], r["my"]) for r in mixture.mixture_step(two, start, hard).collect())
        assert np.allclose(got, [(20, 20), (50, 30)], atol=0.3)
    first = spark.createDataFrame([(0, 0.8, 15.0, 11.0, 0.6, 0.0, 0.6)], "f long, c double, mx double, my double, pxx double, pxy double, pyy double")
    r = mixture.least_squares_fit(pixels(spark, a), first).first()
    assert np.allclose([r["c"], r["mx"], r["my"]], [1, 15.3, 10.6], atol=1e-3) and r["loss"] < 1e-6
    assert r["converged"] and r["slope"] < 1e-8
    place, slope, converged = mixture.minimise(lambda x: (float(((x - 3) ** 4).sum()), 4 * (x - 3) ** 3), np.zeros(2), rounds=2)
    assert not converged and slope == np.abs(4 * (place - 3) ** 3).max() > 1e-8
    step, at = 1e-5, mixture.squared_loss(pixels(spark, a), first).first()
    moved = mixture.squared_loss(pixels(spark, a), first.withColumn("mx", F.col("mx") + step)).first()
    assert math.isclose((moved["loss"] - at["loss"]) / step, at["d_mx"], rel_tol=1e-2)


def test_windows_that_follow_the_means_recover_overlapping_contacts(spark):
    """The golden case of two overlapping contacts: means (11.9, 10.6) and (15.1, 10.6), axes 1 and 2, turned by -35 and 35 degrees."""

    def turned(degrees):
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        along, across = np.array([c, s]), np.array([-s, c])
        return np.outer(along, along) * 2 + np.outer(across, across)

    apart = bump((15.3, 10.6), turned(35)) + bump((35.8, 15.1), 0.3 * turned(-15))
    near = bump((11.9, 10.6), turned(-35)) + bump((15.1, 10.6), turned(35))
    long = pixels(spark, apart, near)
    rows = [(0, 0, 15.0, 11.0), (0, 1, 36.0, 15.0), (1, 0, 12.0, 11.0), (1, 1, 15.0, 11.0)]
    start = spark.createDataFrame([(f, c, 72, 48, 1.0, x, y, 1.0, 0.0, 1.0) for f, c, x, y in rows], "f long, c long, w int, h int, scale double, mx double, my double, pxx double, pxy double, pyy double")
    got = {(r["f"], r["c"]): r for r in fit.fit_multi(start, long, rounds=6, delta=3).collect()}
    for f, c, mean, cov, close in ((0, 0, (15.3, 10.6), turned(35), 0.02), (0, 1, (35.8, 15.1), 0.3 * turned(-15), 0.02), (1, 0, (11.9, 10.6), turned(-35), 0.3), (1, 1, (15.1, 10.6), turned(35), 0.3)):
        r = got[(f, c)]
        assert np.allclose((r["mx"], r["my"]), mean, atol=close)
        assert f or np.allclose(np.linalg.inv([[r["pxx"], r["pxy"]], [r["pxy"], r["pyy"]]]), cov, atol=0.05)
    flat = spark.createDataFrame([(0, 0, 72, 48, 1.0, 60.0, 40.0, 1.0, 0.0, 1.0), (0, 1, 72, 48, 1.0, -9.0, -9.0, 1.0, 0.0, 1.0)], start.schema)
    assert fit.fit_multi(flat, pixels(spark, np.zeros((48, 72))), rounds=1).count() == 0  # singular, and no cell


def test_two_gaussians_by_bfgs(spark):
    a = bump((20.0, 20.0), np.eye(2) * 2, 0.8) + bump((25.0, 21.0), np.eye(2) * 3, 0.5)
    start = spark.createDataFrame([(0, 0, 0.7, 19.5, 20.5, 0.4, 0.0, 0.4), (0, 1, 0.6, 25.5, 20.5, 0.4, 0.0, 0.4)], "f long, k int, c double, mx double, my double, pxx double, pxy double, pyy double")
    for delta in (None, 6):
        got = {r["k"]: r for r in mixture.least_squares_fit(pixels(spark, a), start, delta).collect()}
        assert np.allclose([[got[k][n] for n in ("c", "mx", "my", "pxx", "pyy")] for k in (0, 1)], [(0.8, 20, 20, 0.5, 0.5), (0.5, 25, 21, 1 / 3, 1 / 3)], atol=1e-3) and got[0]["loss"] < 1e-8


def test_mixture_rounds_come_near_the_real_parameters(spark):
    two = pixels(spark, bump((20.0, 20.0), np.eye(2)) + bump((50.0, 30.0), np.eye(2)))
    columns = "f long, k int, mx double, my double, cxx double, cxy double, cyy double"
    start = spark.createDataFrame([(0, k, x, y, 40.0, 0.0, 40.0) for k, x, y in ((0, 15.0, 15.0), (1, 55.0, 35.0))], columns)
    real = spark.createDataFrame([(0, 0, 20.0, 20.0, 1.0, 0.0, 1.0), (0, 1, 50.0, 30.0, 1.0, 0.0, 1.0)], columns)
    errors = {(r["round"], r["k"]): (r["mean_error"], r["cov_error"]) for r in mixture.mixture_rounds(two, start, 4, real=real)[1].collect()}
    assert len(errors) == 8 and all(max(errors[(4, k)]) < 0.01 for k in (0, 1))


def test_eight_neighbours_and_the_step_over_a_row(spark):
    cost, source = RNG.random((6, 8)) * 0.5, RNG.random((6, 8)) > 0.9
    source[0, 0] = True
    mask = RNG.random((6, 8)) > 0.3
    d = dense.distances(source[None], mask[None], cost[None], 1.5, connectivity=8)[0]
    rows = [(0, x, y, bool(source[y, x]), bool(mask[y, x]), float(cost[y, x])) for y in range(6) for x in range(8)]
    got = {(r["x"], r["y"]): r["distance"] for r in distance.distance_relational(spark.createDataFrame(rows, "f long, x int, y int, source boolean, mask boolean, cost double"), 1.5, connectivity=8).collect()}
    assert got.keys() == {(x, y) for y, x in np.argwhere(np.isfinite(d))} and all(math.isclose(v, d[y, x], abs_tol=1e-12) for (x, y), v in got.items())
    column = np.array([[1], [1], [1], [0], [1]], bool)
    assert dense.labels(column[None], 4)[0].ravel().tolist() == [1, 1, 1, 0, 2]
    assert dense.labels(column[None], 4, down=2)[0].ravel().tolist() == [1, 1, 1, 0, 1]


def test_confidence_is_the_score_under_the_mean(spark):
    points = spark.createDataFrame([(0, 3, 2, 1.9, 0.2), (0, 3, 2, -5.0, 9.0)], "f long, w int, h int, mx double, my double")
    scored = spark.createDataFrame([(0, x, y, x + 10.0 * y) for x in range(3) for y in range(2)], "f long, x int, y int, score double")
    assert sorted(r["confidence"] for r in fit.with_confidence(points, scored).collect()) == [1.0, 10.0]


def test_diverging_fits_are_given_up_without_a_warning(recwarn):
    y, x = np.mgrid[:48, :72]
    for data in (np.abs(np.random.default_rng(1).normal(size=(48, 72))), np.exp(((x - 30.0) ** 2 + (y - 20.0) ** 2) / 300), np.zeros((48, 72))):
        found = dense.fit_gaussians(data, [(30, 20), (31, 22), (0, 0), (71, 47)], rounds=8)
        assert len(found) == 4 and all(f is None or (np.isfinite(f[0]) and np.isfinite(f[1]).all()) for f in found)
    assert found == [None] * 4 and not [w for w in recwarn if w.category is RuntimeWarning]


def test_strokes_split_on_lifts_and_keep_an_open_end(spark):
    rows = [("a", "plain", i, m, i, 2 * i) for i, m in enumerate((3, 3, 1, 0, 7, 3, 2, 3))] + [("b", "plain", 0, 0, 0, 0)]
    got = strokes.strokes(spark.createDataFrame(rows, "capture string, kind string, pos long, mode int, x int, y int")).orderBy("pos").collect()
    assert [(r["stroke_id"], r["seq"], r["pos"]) for r in got] == [(1, 0, 0), (1, 1, 1), (2, 0, 4), (2, 1, 5), (3, 0, 7)]


@pytest.mark.parametrize("ranges", ["1", "3", "40"])
def test_strokes_of_streams_in_several_ranges(spark, ranges):
    rng = np.random.default_rng(6)
    modes = [*(3 * int(v) for v in rng.random(150) < 0.6), *[3] * 90, 0, *[3] * 60]  # a stroke that is longer than a range
    rows = [("a", "plain", i, m, i, 2 * i) for i, m in enumerate(modes)] + [("b", k, i, m, i, i) for k in ("plain", "serial") for i, m in enumerate((3, 0, 3))] + [("c", "plain", 5, 0, 1, 1)]
    made = spark.createDataFrame(rows, "capture string, kind string, pos long, mode int, x int, y int")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = sorted(map(tuple, strokes.strokes_in_ranges(made).collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == sorted(map(tuple, strokes.strokes(made).collect()))
    assert strokes.strokes_in_ranges(made.limit(0)).isEmpty()


def record(kind, body):
    return capture.REPORT.pack(kind, len(body)) + body


def device_buffer(*reports, frame_type=0x07):
    body = b"".join(reports)
    frame = capture.FRAME.pack(5, frame_type, len(body)) + body
    return capture.DATA.pack(0, capture.PAYLOAD.size + len(frame), 9) + capture.PAYLOAD.pack(77, 1) + frame


def test_capture_dimensions_carry_forward_and_change_midway(spark):
    dim = lambda h, w, low=0, high=255: record(capture.DIMENSIONS, bytes((h, w, 0, 0, 0, 0, low, high)))
    heat = lambda *cells: record(capture.HEATMAP, bytes(cells))
    content = device_buffer(heat(1), dim(1, 2, 5, 105), heat(5, 105)) + device_buffer(heat(55, 5), dim(2, 1), heat(0, 255), record(0x999, b"xx"))
    one = spark.createDataFrame([("c", bytearray(content)), ("empty", bytearray(b"")), ("cut", bytearray(content[:-3]))], "path string, content binary")
    got = capture.heatmaps(capture.reports(one)).where("capture = 'c'").orderBy("f").collect()
    assert [(r["w"], r["h"], [round(v, 3) for v in r["px"]]) for r in got] == [(2, 1, [1.0, 0.0]), (2, 1, [0.5, 1.0]), (1, 2, [1.0, 0.0])]
    assert {(r["kind"], r["type"]) for r in capture.unknown_types(one.where("path = 'c'")).collect()} == {("report", 0x999)}
    assert capture.diagnostics(one, "ERR").where("capture = 'cut'").count() == 1
    with pytest.raises(capture.TruncatedCapture):
        list(capture.walk(content[:-3], strict=True))
    assert len(list(capture.walk(content, oneshot=True))) == 3


def test_payloads_hold_as_many_frames_as_they_say(spark):
    body = record(capture.HEATMAP, b"x")
    frame = capture.FRAME.pack(5, 0x07, len(body)) + body

    def payload(frames, promised, rest=b""):
        inside = capture.PAYLOAD.pack(77, promised) + frame * frames + rest
        return capture.DATA.pack(0, len(inside), 9) + inside

    walked = lambda content: [(r[0], *r[2:4]) if r[0] == "note" else r[0] for r in capture.walk(content)]
    assert walked(payload(2, 2)) == ["report", "report"]
    assert walked(payload(2, 1)) == ["report", ("note", 2, "payload")]  # what is left is logged, not read
    assert walked(payload(1, 1, b"zzz") + payload(1, 1)) == ["report", ("note", 2, "payload"), "report"]
    assert walked(payload(1, 3)) == ["report", ("note", 3, "payload")]
    assert walked(payload(0, 0)) == []
    assert len(list(capture.walk(payload(2, 1), strict=True))) == 2
    with pytest.raises(capture.TruncatedCapture, match="1 of 3 frames"):
        list(capture.walk(payload(1, 3), strict=True))
    one = spark.createDataFrame([("c", bytearray(payload(2, 1)))], "path string, content binary")
    assert capture.reports(one).count() == 1 and capture.diagnostics(one).first()["message"].endswith("after the last of 1 frames")


def test_raw_reports_have_typed_views(spark):
    content = device_buffer(record(0x4FF, (70_000).to_bytes(4, "little")), record(0x800, b"\0\0" + (5).to_bytes(2, "little") + (9).to_bytes(4, "little")), record(0x803, bytes(range(8))))
    found = capture.reports(spark.createDataFrame([("c", bytearray(content))], "path string, content binary"))
    assert capture.counters(found).first()["counter"] == 70_000
    assert tuple(capture.timestamps(found).select("counter", "timestamp").first()) == (5, 9)
    assert tuple(capture.dimensions(found).first())[2:] == tuple(range(8))


def test_stylus_samples(spark):
    sample = lambda *v: b"".join(x.to_bytes(2, "little") for x in v) + b"\0\0"
    body = sample(1, 3, 40000, 7, 8, 9, 10) + sample(2, 1, 5, 6, 7, 8, 9)
    content = device_buffer(record(capture.STYLUS_SERIAL, bytes((2, 0, 0, 0)) + (123456789).to_bytes(4, "little") + body), record(capture.STYLUS, bytes((2, 0, 0, 0)) + body[:16]))
    got = capture.stylus(capture.reports(spark.createDataFrame([("c", bytearray(content))], "path string, content binary"))).orderBy("pos", "idx").collect()
    assert [(r["kind"], r["serial"], r["idx"], r["mode"], r["x"]) for r in got] == [("serial", 123456789, 0, 3, 40000), ("serial", 123456789, 1, 1, 5), ("plain", None, 0, 3, 40000)]


def test_cut_samples_are_told(spark):
    sample = bytes(range(16))
    content = device_buffer(record(capture.STYLUS, bytes((3, 0, 0, 0)) + sample), record(capture.STYLUS_SERIAL, bytes((2, 0, 0, 0, 1, 0, 0, 0)) + sample + sample[:9]), record(capture.STYLUS, bytes((1, 0))), record(capture.STYLUS, bytes((1, 0, 0, 0)) + sample))
    made = spark.createDataFrame([("c", bytearray(content))], "path string, content binary")
    assert [r["message"] for r in capture.diagnostics(made, "ERR").orderBy("pos").collect()] == ["2 of 3 samples are missing", "1 of 2 samples are missing", "header of samples is cut"]
    assert capture.stylus(capture.reports(made)).count() == 3


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0x400, 0x403, 0x425, 0x800, 0x123]), st.binary(max_size=20)), max_size=6))
def test_walk_returns_what_was_written(items):
    found = [r for r in capture.walk(device_buffer(*(record(k, b) for k, b in items))) if r[0] == "report"]
    assert [(r[6], r[7]) for r in found] == items


def test_colours(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "u double")
    r, g, b = colour.cubehelix(F.col("u"))
    got = d.select(r.alias("r"), g.alias("g"), b.alias("b")).collect()
    assert np.allclose(got[0], 0) and np.allclose(got[2], 1)
    table = colour.table_map(F.col("u"), [(0, 0, 0), (1, 0.5, 0)])
    assert d.select(table[0].alias("r"), table[1].alias("g")).collect()[1] == (0.5, 0.25)
    r, g, b = colour.polynomial(F.col("u"), colour.POLYNOMIALS["viridis"])  # ends and middle of the published table
    for got, want in zip(d.select(r, g, b).collect(), ((0.267, 0.005, 0.329), (0.128, 0.567, 0.551), (0.993, 0.906, 0.144)), strict=True):
        assert np.allclose(got, want, atol=0.02)


def test_relational_forms_raise_when_rounds_do_not_suffice(spark):
    long = spark.createDataFrame([(0, x, y, 1.0, 3, 3) for x in range(3) for y in range(3)], "f long, x int, y int, v double, w int, h int")
    with pytest.raises(RuntimeError, match="labels did not settle in 1 rounds"):
        components.label_relational(long, 0.0, 4, rounds=1)
    marked = spark.createDataFrame([(0, x, 0, x == 0, True, 0.5) for x in range(5)], "f long, x int, y int, source boolean, mask boolean, cost double")
    with pytest.raises(RuntimeError, match="distances did not settle in 1 rounds"):
        distance.distance_relational(marked, 6.0, rounds=1)


def test_fits_and_their_windows_broadcast_nothing(spark):
    """Cells are many times what they are made of, so Spark's estimate of them is far too low for a broadcast."""
    contacts = spark.range(40).select((F.col("id") % 2).alias("f"), "id", (F.col("id") * 7 % 72).cast("int").alias("mx"), (F.col("id") * 13 % 48).cast("int").alias("my"), F.lit(0.5).alias("amplitude"))
    pixels = frames.splat(contacts)
    peaks = stencil.local_maxima(pixels, "v", 0.3)
    for made in (fit.iterate(fit.candidates(peaks), pixels), fit.refit(fit.starts(peaks), pixels)):
        assert made.count() and "Broadcast" not in made._jdf.queryExecution().toString()


def test_splat_is_the_sum_of_its_contacts_also_from_outside(spark):
    rows = [(7, 0, 3, 4, 0.5), (7, 1, 3, 4, 0.25), (7, 2, -4, 20, 1.0), (7, 3, 75, 50, 1.0), (7, 4, 500, 20, 1.0), (8, 5, 71, 47, None)]
    found = {r["f"]: np.array(r["px"]).reshape(48, 72) for r in frames.splat_dense(spark.createDataFrame(rows, "f long, id long, mx int, my int, amplitude double")).collect()}
    y, x = np.mgrid[:48, :72]
    near = [np.where((abs(x - mx) <= 5) & (abs(y - my) <= 5), a * np.exp(-((x - mx) ** 2 + (y - my) ** 2) / 4.5), 0) for _, _, mx, my, a in rows[:4]]
    assert np.allclose(found[7], sum(near), atol=1e-12) and not found[8].any()


def test_components_beyond_those_written_out_are_fitted_the_same(spark, monkeypatch):
    pixels = spark.range(400).select(F.lit(1).cast("long").alias("f"), (F.col("id") % 20).cast("int").alias("x"), F.expr("cast(id div 20 as int)").alias("y"), (F.col("id") % 7 + 1).cast("double").alias("v"))
    params = spark.createDataFrame([(1, k, 4.0 + k // 2 * 9, 9.0, 20.0, 1.0, 30.0) for k in range(4)], "f long, k int, mx double, my double, cxx double, cxy double, cyy double")
    for hard in (False, True):
        plain = sorted(map(tuple, mixture.mixture_step(pixels, params, hard).collect()))
        with monkeypatch.context() as m:
            m.setattr(mixture, "WRITTEN_OUT", 0)
            other = sorted(map(tuple, mixture.mixture_step(pixels, params, hard).collect()))
        assert len(plain) == (2 if hard else 4) and np.allclose(plain, other)
