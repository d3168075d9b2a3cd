"""Tiled labels and distances against those of whole frames, and star contraction."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactigrid.operators import dense, tiles
from tactigrid.operators.contraction import contract

RNG = np.random.default_rng(8)


def pixels(spark, *arrays):
    rows = [(f, x, y, float(a[y, x]), a.shape[1], a.shape[0]) for f, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "f long, x int, y int, v double, w int, h int")


def image(rows, shape, column, none):
    out = np.full(shape, none)
    out[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows[column].to_numpy()
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tiled_labels_equal_those_of_whole_frames(spark, connectivity):
    arrays = [(RNG.random(shape) < share).astype(float) for shape, share in (((17, 23), 0.55), ((40, 31), 0.45), ((8, 8), 1.0), ((5, 5), 0.0), ((1, 30), 0.7), ((30, 1), 0.7))]
    got = tiles.label(pixels(spark, *arrays), 0.5, connectivity, tile=8).labels.toPandas()
    for f, a in enumerate(arrays):
        assert (image(got[got.f == f], a.shape, "label", 0) == dense.labels(a[None] > 0.5, connectivity)[0]).all(), f


def serpentine(spark, size):
    """One path through every other row, joined at alternating ends."""
    cells = spark.range(size * size).select(F.lit(0).cast("long").alias("f"), (F.col("id") % size).cast("int").alias("x"), F.expr(f"cast(id div {size} as int)").alias("y"), F.lit(size).alias("w"))
    turn = F.when(F.expr("y div 2 % 2 = 0"), F.col("x") == size - 1).otherwise(F.col("x") == 0)
    return cells.withColumn("v", F.when((F.col("y") % 2 == 0) | turn, 1.0).otherwise(0.0))


def test_rounds_grow_with_the_logarithm_of_the_path(spark):
    """A path of half the pixels that crosses from tile to tile some size^2 / 2 / tile times."""
    rounds = {}
    for size in (128, 512):
        found = tiles.label(serpentine(spark, size), 0.5, 4, tile=64)
        assert found.labels.agg(F.min("label"), F.max("label"), F.count("*")).first()[:] == (1, 1, size * size // 2 + size // 2)
        rounds[size] = found.rounds
    crossings = {size: size * size // 2 // 64 for size in rounds}
    assert all(rounds[s] <= 2 * math.log2(crossings[s]) for s in rounds) and rounds[512] <= rounds[128] + 2 * math.log2(crossings[512] / crossings[128])


def test_contraction_of_paths_stars_and_cycles(spark):
    edges = [(0, i, i + 1) for i in range(1000)] + [(1, 5, i) for i in range(6, 900)] + [(2, i, (i + 1) % 64) for i in range(64)] + [(3, 7, 7)]
    found = contract(spark.createDataFrame(edges, "f long, u long, v long"))
    assert found.roots.groupBy("f").agg(F.min("root"), F.max("root"), F.count("*")).orderBy("f").collect() == [(0, 0, 0, 1001), (1, 5, 5, 895), (2, 0, 0, 64)]
    assert found.rounds <= 2 * math.log2(1000)
    with pytest.raises(RuntimeError):
        contract(spark.createDataFrame(edges, "f long, u long, v long"), most=1)
    assert contract(spark.createDataFrame([], "f long, u long, v long")).roots.isEmpty()


@pytest.mark.parametrize(("connectivity", "delta", "tile"), [(4, None, 8), (8, 0.4, 8), (4, 0.3, 5), (8, None, 64)])
def test_tiled_distances_equal_those_of_whole_frames(spark, connectivity, delta, tile):
    shapes = ((20, 33), (24, 9), (6, 6))
    made = [(RNG.random(s) < 0.04, RNG.random(s) < 0.8, np.round(RNG.random(s) * 0.3, 3)) for s in shapes]
    made[2] = (np.zeros((6, 6), bool), *made[2][1:])
    rows = [(f, x, y, bool(s[y, x]), bool(m[y, x]), float(c[y, x])) for f, (s, m, c) in enumerate(made) for y in range(s.shape[0]) for x in range(s.shape[1])]
    table = spark.createDataFrame(rows, "f long, x int, y int, source boolean, mask boolean, cost double")
    found = tiles.distance(table, 2.0, 0.1, connectivity, tile, delta)
    got = found.cells.toPandas()
    for f, (s, m, c) in enumerate(made):
        want = dense.distances(s[None], m[None], c[None], 2.0, 0.1, connectivity)[0]
        assert (image(got[got.f == f], s.shape, "distance", np.inf) == want).all(), f
    assert found.rounds <= 22 * (1 if delta is None else math.ceil(2.0 / delta))


def test_a_corridor_through_tiles_takes_a_round_a_border(spark):
    rows = [(0, x, 0, x == 0, True, 0.0) for x in range(60)]
    table = spark.createDataFrame(rows, "f long, x int, y int, source boolean, mask boolean, cost double")
    found = tiles.distance(table, 100.0, 1.0, 4, tile=10)
    assert found.rounds == 6 and {r["x"]: r["distance"] for r in found.cells.collect()} == {x: float(x) for x in range(60)}
    assert tiles.distance(table.where("x > 0"), 100.0, 1.0, 4, tile=10).cells.isEmpty()
