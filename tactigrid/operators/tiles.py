"""Labels and distances of frames too large for a task: dense tiles in numpy, their borders as joins.

A frame is cut into tiles of `tile` x `tile` pixels. What lies within a tile is solved there, by the functions that solve whole
frames; only what crosses a border becomes rows. So joins carry border pixels (4 * tile of tile^2) and tiles, never all
pixels, and rounds follow the number of borders that a component or path crosses instead of its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.operators import dense
from tactigrid.operators.contraction import contract
from tactigrid.session import checkpointed, ship_package

_TILE = ["f", "tx", "ty"]
#: Of a stack of tiles that numpy solves at once.
CELLS = 1 << 19


def _with_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    return pixels.withColumn("tx", F.expr(f"x div {tile}")).withColumn("ty", F.expr(f"y div {tile}"))


# ---- labels


@dataclass(frozen=True)
class Labelled:
    #: f, x, y, label of the foreground.
    labels: DataFrame
    rounds: int


def _slices(rows: int, tile: int) -> Iterator[slice]:
    """Rows of a batch, some at a time: so many that their tiles together have about CELLS cells."""
    several = max(1, CELLS // (tile * tile))
    yield from (slice(k, min(k + several, rows)) for k in range(0, rows, several))


def _flat(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a column of lists of structs: each struct's row, and its fields."""
    lengths = np.diff(column.offsets.to_numpy())
    inner = column.flatten()
    return np.repeat(np.arange(len(lengths)), lengths), {inner.type.field(k).name: x.to_numpy(zero_copy_only=False) for k, x in enumerate(inner.flatten())}


def _local_components(pixels: DataFrame, tile: int, connectivity: int) -> DataFrame:
    """f, x, y, part, edge: of foreground pixels (f, x, y, w), the least raster index of their component within the tile, and whether they are on its border."""
    ship_package(pixels.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in _slices(whole.num_rows, tile):
                batch = whole.slice(some.start, some.stop - some.start)
                row, cell = _flat(batch.column("cells"))
                x, y = cell["x"].astype(np.int64), cell["y"].astype(np.int64)
                own_x, own_y = x % tile, y % tile
                mask = np.zeros((batch.num_rows, tile, tile), bool)
                mask[row, own_y, own_x] = True
                found = dense.labels(mask, connectivity)[row, own_y, own_x]
                key = row * (found.max(initial=0) + 1) + found
                least = np.full(key.max(initial=0) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, key, y * batch.column("w").to_numpy()[row] + x)
                edge = (own_x == 0) | (own_x == tile - 1) | (own_y == 0) | (own_y == tile - 1)
                columns = [batch.column("f").take(pa.array(row)), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(least[key], pa.int64()), pa.array(edge)]
                yield pa.RecordBatch.from_arrays(columns, names=["f", "x", "y", "part", "edge"])

    keyed = _with_tiles(pixels.select(F.col("f").cast("long").alias("f"), "x", "y", "w"), tile)
    gathered = keyed.groupBy(*_TILE).agg(F.max("w").cast("long").alias("w"), F.collect_list(F.struct("x", "y")).alias("cells"))
    return gathered.select("f", "w", "cells").mapInArrow(label, "f long, x int, y int, part long, edge boolean")


def _numbered(roots: DataFrame) -> DataFrame:
    """f, root, label: roots of each frame in order, from 1; counted within ranges, then over the ranges, so that no frame is one task's."""
    dealt = checkpointed(roots.repartitionByRange("f", "root").withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("f", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("f").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = counts.select("f", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("range", "f").orderBy("root"))
    return dealt.withColumn("place", within).join(bases, ["f", "range"]).select("f", "root", (F.col("base") + F.col("place")).cast("int").alias("label"))


def label(pixels: DataFrame, threshold: float = 0.0, connectivity: int = 4, tile: int = 256) -> Labelled:
    """Connected components of the pixels (f, x, y, v, w) over the threshold, numbered from 1 in raster order of their first pixels.

    1. A tile's components, named by their least raster index. 2. Border pixels meet their neighbours in other tiles by equality;
    pairs of components are edges. 3. Star contraction finds the least name of each. 4. Names are numbered, and go back to the pixels by
    the component within the tile, of which no key has more than a tile's pixels.
    """
    found = checkpointed(_local_components(pixels.where(F.col("v") > threshold), tile, connectivity))
    borders = found.where("edge").select("f", "x", "y", "part")
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if connectivity == 8 else [])
    ahead = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps))
    reached = borders.select("f", "part", "x", "y", F.explode(ahead).alias("to"))
    across = (F.expr(f"to.x div {tile} != x div {tile} or to.y div {tile} != y div {tile}")) & (F.col("to.x") >= 0)
    pairs = reached.where(across).select("f", F.col("part").alias("u"), F.col("to.x").alias("x"), F.col("to.y").alias("y")).join(borders.withColumnRenamed("part", "v"), ["f", "x", "y"])
    contracted = contract(pairs.select("f", "u", "v").distinct())
    parts = found.select("f", "part").distinct()
    rooted = checkpointed(parts.join(contracted.roots.withColumnRenamed("node", "part"), ["f", "part"], "left").select("f", "part", F.coalesce("root", "part").alias("root")))
    named = rooted.join(_numbered(rooted.select("f", "root").distinct()), ["f", "root"]).select("f", "part", "label")
    return Labelled(found.join(named, ["f", "part"]).select("f", "x", "y", "label"), contracted.rounds)


# ---- distances


@dataclass(frozen=True)
class Distances:
    #: f, x, y, distance of the cells reached.
    cells: DataFrame
    rounds: int


_STEPS = {4: [(-1, 0), (1, 0), (0, -1), (0, 1)], 8: [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]}
_SOURCE, _OPEN = 1, 2


def _cells(pixels: DataFrame, tile: int) -> DataFrame:
    """f, tx, ty, start (whether there is a source), kind (a byte a cell, 0 where there is none), cost (doubles): tiles of pixels (f, x, y, source, mask, cost)."""
    ship_package(pixels.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in _slices(whole.num_rows, tile):
                batch = whole.slice(some.start, some.stop - some.start)
                row, cell = _flat(batch.column("cells"))
                at = cell["y"] % tile * tile + cell["x"] % tile
                kind, cost = np.zeros((batch.num_rows, tile * tile), np.uint8), np.zeros((batch.num_rows, tile * tile))
                kind[row, at], cost[row, at] = cell["kind"], cell["cost"]
                columns = [*(batch.column(c) for c in _TILE), pa.array((kind == _SOURCE).any(1)), pa.array([k.tobytes() for k in kind], pa.binary()), pa.array([c.tobytes() for c in cost], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*_TILE, "start", "kind", "cost"])

    kind = F.when(F.col("source"), _SOURCE).when(F.col("mask"), _OPEN).otherwise(0)
    keyed = _with_tiles(pixels.select(F.col("f").cast("long").alias("f"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), kind.alias("kind"), F.col("cost").cast("double").alias("cost")), tile)
    gathered = keyed.groupBy(*_TILE).agg(F.collect_list(F.struct("x", "y", "kind", "cost")).alias("cells"))
    return gathered.mapInArrow(pack, "f long, tx long, ty long, start boolean, kind binary, cost binary")


def relax(kind: np.ndarray, cost: np.ndarray, known: np.ndarray, arrivals: np.ndarray, limit: float, step: float, connectivity: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """A stack of tiles: distances after arrivals (inf where there are none), and what leaves them: row, dx and dy to the next tile, cell there, distance.

    Sources arrive at 0, once. Arrivals that don't improve a cell do nothing; only cells that improved send.
    """
    tile, open_ = kind.shape[-1], kind == _OPEN
    d = np.where((kind != 0) & (arrivals < known), arrivals, known)
    lengths = [(dx, dy, step * (2**0.5 if dx and dy else 1.0)) for dx, dy in _STEPS[connectivity]]
    while True:
        left = d + cost
        low = np.minimum.reduce([dense.shifted(left, -dy, -dx, np.inf) + length for dx, dy, length in lengths])
        better = open_ & (low < d) & (low < limit)
        if not better.any():
            break
        d = np.where(better, low, d)
    improved = d < known
    improved[:, 1:-1, 1:-1] = False
    row, y, x = np.nonzero(improved)
    sent = []
    for dx, dy, length in lengths:
        to_x, to_y, value = x + dx, y + dy, d[row, y, x] + cost[row, y, x] + length
        over_x, over_y = (to_x >= tile).astype(int) - (to_x < 0), (to_y >= tile).astype(int) - (to_y < 0)
        leaves = ((over_x != 0) | (over_y != 0)) & (value < limit)
        sent.append([c[leaves] for c in (row, over_x, over_y, to_y % tile * tile + to_x % tile, value)])
    return d, tuple(map(np.concatenate, zip(*sent, strict=True)))


def distance(pixels: DataFrame, limit: float = 6.0, step: float = 0.1, connectivity: int = 4, tile: int = 128, delta: float | None = None) -> Distances:
    """Least cost from a source over open cells, below the limit: pixels (f, x, y, source, mask, cost) as for `distance_relational`.

    Delta-stepping between tiles: what has left a tile waits in buckets of width `delta` (by default the limit: one bucket); a round takes
    the lowest bucket, lets the tiles it reaches settle in themselves, and keeps what leaves them. Tiles' cells stay where they were
    dealt; a round moves border cells and the distances of the tiles that it reaches, no others. Rounds: each takes the front over
    at least one more border, so at most limit / step in every bucket, and as few as the borders that least paths cross.
    """
    delta = delta or limit
    tiles = checkpointed(_cells(pixels, tile).repartition(*_TILE))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in _slices(whole.num_rows, tile):
                batch = whole.slice(some.start, some.stop - some.start)
                n, shape = batch.num_rows, (batch.num_rows, tile, tile)
                kind, cost = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(shape) for c, t in (("kind", np.uint8), ("cost", float)))
                far = np.full(tile * tile, np.inf).tobytes()
                known = np.frombuffer(b"".join(x or far for x in batch.column("distance").to_pylist())).reshape(shape)
                row, cell = _flat(batch.column("arrivals"))
                arrivals = np.full((n, tile * tile), np.inf)
                arrivals[row, cell["cell"]] = cell["d"]
                first = batch.column("first").to_numpy(zero_copy_only=False)
                arrivals[first[:, None] & (kind.reshape(n, -1) == _SOURCE)] = 0
                d, (row, dx, dy, at, value) = relax(kind, cost, known, arrivals.reshape(shape), limit, step, connectivity)
                order = np.argsort(row, kind="stable")
                tx, ty = (batch.column(c).to_numpy()[row] + over for c, over in (("tx", dx), ("ty", dy)))
                inner = pa.StructArray.from_arrays([pa.array(tx[order], pa.int64()), pa.array(ty[order], pa.int64()), pa.array(at[order], pa.int32()), pa.array(value[order], pa.float64())], ["tx", "ty", "cell", "d"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _TILE), pa.array([x.tobytes() for x in d], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), inner)], names=[*_TILE, "distance", "sent"])

    schema = "f long, tx long, ty long, distance binary, sent array<struct<tx:long, ty:long, cell:int, d:double>>"
    def leaving(out: DataFrame) -> DataFrame:
        return out.select("f", F.inline("sent")).select("f", "tx", "ty", "cell", "d")

    none = F.array().cast("array<struct<cell:int, d:double>>")
    first = tiles.where("start").select(*_TILE, "kind", "cost", none.alias("arrivals"), F.lit(None).cast("binary").alias("distance"), F.lit(True).alias("first"))
    out = checkpointed(first.mapInArrow(settle, schema))
    seen, waiting = out.select(*_TILE, "distance", F.lit(0).alias("round")), leaving(out)
    most = (int(limit / step) + 2) * -int(-limit // delta)
    for done in range(1, most + 2):
        low = waiting.agg(F.min("d")).first()[0]
        if low is None:
            break
        end = (low // delta + 1) * delta
        waiting = checkpointed(waiting.groupBy(*_TILE, "cell").agg(F.min("d").alias("d")))
        arrived = waiting.where(F.col("d") < end).groupBy(*_TILE).agg(F.collect_list(F.struct("cell", "d")).alias("arrivals"))
        latest = seen.join(arrived.select(*_TILE), _TILE, "left_semi").groupBy(*_TILE).agg(F.max_by("distance", "round").alias("distance"))
        active = tiles.join(arrived, _TILE).join(latest, _TILE, "left").select(*_TILE, "kind", "cost", "arrivals", "distance", F.lit(False).alias("first"))
        out = checkpointed(active.mapInArrow(settle, schema))
        seen = seen.unionByName(out.select(*_TILE, "distance", F.lit(done).alias("round")))
        waiting = waiting.where(F.col("d") >= end).unionByName(leaving(out))
    else:
        raise RuntimeError(f"distances did not settle in {most} rounds")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, tx, ty, data in zip(*(batch.column(c).to_pylist() for c in (*_TILE, "distance")), strict=True):
                d = np.frombuffer(data)
                at = np.flatnonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f)), pa.array((tx * tile + at % tile).astype(np.int32)), pa.array((ty * tile + at // tile).astype(np.int32)), pa.array(d[at])], names=["f", "x", "y", "distance"])

    last = seen.groupBy(*_TILE).agg(F.max_by("distance", "round").alias("distance"))
    return Distances(last.mapInArrow(unpack, "f long, x int, y int, distance double"), done - 1)
