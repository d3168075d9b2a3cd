"""Frames: dense (f, w, h, px) and long (f, x, y, v, w, h) layouts, and frames derived from business tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.session import ship_package

#: Frames that are worked on at a time, so that a worker's memory doesn't follow the length of its batches.
STACK = 64
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def to_long(dense: DataFrame) -> DataFrame:
    """Row-major arrays to pixels."""
    return dense.select("f", F.posexplode("px").alias("i", "v"), "w", "h").select("f", (F.col("i") % F.col("w")).cast("int").alias("x"), F.expr("cast(i div w as int)").alias("y"), "v", "w", "h")


def to_long_columns(dense: DataFrame, columns: list[str]) -> DataFrame:
    """Several row-major arrays of one length to pixels with a column each."""
    each = dense.select("f", "w", "h", F.posexplode(F.arrays_zip(*columns)).alias("i", "z"))
    return each.select("f", (F.col("i") % F.col("w")).cast("int").alias("x"), F.expr("cast(i div w as int)").alias("y"), *(F.col(f"z.{c}").alias(c) for c in columns), "w", "h")


def to_dense(long: DataFrame, value: str = "v") -> DataFrame:
    """Pixels to row-major arrays; every cell must be there."""
    cells = F.array_sort(F.collect_list(F.struct((F.col("y") * F.col("w") + F.col("x")).alias("i"), F.col(value).alias("v"))))
    return long.groupBy("f", "w", "h").agg(F.transform(cells, lambda z: z["v"]).alias("px"))


def to_dense_columns(long: DataFrame, columns: list[str]) -> DataFrame:
    """Several measures of the pixels to row-major arrays of the same names: f, w, h, arrays."""
    cells = F.array_sort(F.collect_list(F.struct((F.col("y") * F.col("w") + F.col("x")).alias("i"), *columns)))
    return long.groupBy("f", "w", "h").agg(cells.alias("cells_")).select("f", "w", "h", *(F.col(f"cells_.{c}").alias(c) for c in columns))


def together(long: DataFrame) -> DataFrame:
    """One exchange by frame; every operator of the engine keeps it.

    Joins of pixels, on (f, x, y), may then keep it too: Spark would else ask for a partitioning on all three.
    """
    long.sparkSession.conf.set(_CO_PARTITION, "false")
    return long.repartition("f")


def embedding_dense(spark: SparkSession, sf_dir: str, scale: int = 100) -> DataFrame:
    """Each vector of 64 numbers as an 8x8 frame of whole numbers."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("f"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.transform("embedding", lambda e: F.floor(e.cast("double") * scale + 0.5).cast("int")).alias("px"))


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together(to_long(embedding_dense(spark, sf_dir)))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as contacts on a 72x48 grid: f (user), id, mx, my, amplitude."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("user_id").alias("f"),
        F.col("event_id").alias("id"),
        (F.col("event_id") * 7 % 72).cast("int").alias("mx"),
        (F.col("event_id") * 13 % 48).cast("int").alias("my"),
        (0.2 + F.abs(F.coalesce("value", F.lit(0.0))) % 100 / 200).alias("amplitude"),
    )


def _splatted(width: int, height: int, sigma: float, reach: int):
    """Of each frame's places (distinct mx, my, with an amplitude), the row-major sum of their Gaussians."""
    weights = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigma**2))) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]
    wide, high = width + 4 * reach, height + 4 * reach  # contacts may lie outside, as far as they reach in

    @F.arrow_udf("array<double>")
    def run(places: pa.Array) -> pa.Array:
        flat = places.flatten()
        frame = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
        mx, my, amplitude = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        made = []
        for low in range(0, len(places), STACK):
            own = slice(*np.searchsorted(frame, (low, low + STACK)))
            grid = np.zeros((min(STACK, len(places) - low), high, wide))
            cells = grid.reshape(-1)
            at = ((frame[own] - low) * high + my[own] + 2 * reach) * wide + mx[own] + 2 * reach
            for dx, dy, weight in weights:  # places are distinct: no cell twice in an addition
                cells[at + dy * wide + dx] += amplitude[own] * weight
            made.append(grid[:, 2 * reach : 2 * reach + height, 2 * reach : 2 * reach + width].reshape(-1))
        offsets = np.arange(0, len(places) * width * height + 1, width * height, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made) if made else np.empty(0)))

    return run


def partitions_of(spark: SparkSession) -> int:
    """All of the session's shuffle partitions, or one for each core, if these are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def splat_dense(contacts: DataFrame, width: int = 72, height: int = 48, sigma: float = 1.5, reach: int = 5, partitions: int | None = None, own: DataFrame | None = None) -> DataFrame:
    """Sum of Gaussians of the contacts of each frame over its whole grid (f, w, h, px).

    Contacts at one place are summed first, so that a frame has at most one for each cell that it or its surroundings have,
    however many events it has; then they are dealt by frame. The grid is made where they are.

    Contacts are some hundred times smaller than the cells they make, so the number of partitions mustn't follow their size:
    it is given (by default see `partitions_of`) and stays.

    own: f, once each, and further columns of frames, which come along; frames that it doesn't have are left out. It is joined
    while frames are still contacts: Spark would deal grids again for a join.
    """
    spark = contacts.sparkSession
    ship_package(spark)
    near = F.col("mx").between(-reach, width - 1 + reach) & F.col("my").between(-reach, height - 1 + reach)
    places = contacts.groupBy("f", "mx", "my").agg(F.coalesce(F.sum("amplitude").cast("double"), F.lit(0.0)).alias("amplitude")).repartition(partitions or partitions_of(spark), "f")
    place = F.when(near, F.struct(F.col("mx").cast("long").alias("mx"), F.col("my").cast("long").alias("my"), "amplitude"))
    by_frame = places.groupBy("f").agg(F.array_sort(F.collect_list(place)).alias("places"))
    if own is not None:
        by_frame = by_frame.join(own.hint("shuffle_hash"), "f")
    along = [c for c in by_frame.columns if c not in ("f", "places")]
    return by_frame.select("f", F.lit(width).alias("w"), F.lit(height).alias("h"), _splatted(width, height, sigma, reach)("places").alias("px"), *along)


def splat(contacts: DataFrame, width: int = 72, height: int = 48, sigma: float = 1.5, reach: int = 5, partitions: int | None = None) -> DataFrame:
    """The same in long form (f, x, y, v, w, h), partitioned by frame. Arrays are dealt, cells are not; uses of one plan share them."""
    made = splat_dense(contacts, width, height, sigma, reach, partitions)
    return to_long(made.repartition(partitions or partitions_of(contacts.sparkSession), "f")).select("f", "x", "y", "v", "w", "h")


def touch_pixels(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """Splatted events; `keep` may choose among the contacts."""
    spark.conf.set(_CO_PARTITION, "false")
    contacts = touches(spark, sf_dir)
    return splat(keep(contacts) if keep else contacts)


def quantity_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by ship year as 72x48 frames of summed quantities, with zeros where there are none."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = items.select(F.year("l_shipdate").cast("long").alias("f"), (F.col("l_orderkey") % 72).cast("int").alias("x"), (F.col("l_partkey") % 48).cast("int").alias("y"), F.col("l_quantity").alias("v"))
    sums = sums.groupBy("f", "x", "y").agg(F.sum("v").alias("v"))
    grid = sums.select("f").distinct().select("f", F.explode(F.sequence(F.lit(0), F.lit(71))).alias("x")).select("f", "x", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("y"), F.lit(0.0).alias("v"))
    return sums.unionByName(grid).groupBy("f", "x", "y").agg(F.sum("v").alias("v")).select("f", "x", "y", "v", F.lit(72).alias("w"), F.lit(48).alias("h"))
