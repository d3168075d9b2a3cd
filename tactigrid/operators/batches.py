"""Running a numpy function over batches of dense frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.session import ship_package
from tactigrid.sources.frames import STACK

Columns = dict[str, np.ndarray]
Stacks = Iterator[tuple[np.ndarray, list[np.ndarray]]]


def stacks(batch: pa.RecordBatch, columns: list[str], most: int | None = None) -> Stacks:
    """(row numbers, one array (frames, h, w) per column) for each frame size of a batch of (f, w, h, arrays); at most so many frames at a time."""
    w, h = (batch.column(c).to_numpy() for c in ("w", "h"))
    sizes = np.stack([h, w], 1)
    for height, width in np.unique(sizes, axis=0):
        of_size = np.flatnonzero((h == height) & (w == width))
        for rows in np.split(of_size, range(most, len(of_size), most)) if most else [of_size]:
            arrays = []
            for name in columns:
                column = batch.column(name).take(pa.array(rows))
                values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                if len(values) != len(rows) * height * width:
                    raise ValueError(f"{name}: a frame doesn't have {width} x {height} cells")
                arrays.append(values.reshape(len(rows), height, width))
            yield rows, arrays


def map_pixels(function: Callable[..., np.ndarray], columns: list[str], target: str, kind: pa.DataType, carry: tuple[str, ...] = ()) -> Callable:
    """For mapInArrow: (f, w, h, carried columns, target) with the function's frame for each frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, arrays in stacks(batch, columns):
                made = function(*arrays)
                flat = pa.array(made.reshape(-1), kind)
                offsets = np.arange(0, len(flat) + 1, made[0].size, dtype=np.int32)
                keys = [batch.column(c).take(pa.array(rows)) for c in ("f", "w", "h", *carry)]
                yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["f", "w", "h", *carry, target])

    return run


def rows_of_frames(frames: DataFrame, function: Callable[..., Iterator[Columns]], columns: dict[str, str], own: tuple[str, ...] = ()) -> DataFrame:
    """f and the function's columns for stacks of the frames, of which it gets px and the Arrow arrays of the columns own; it names a row's frame in `frame`.

    Frames whose f is null are left out, as joins leave them out.
    """
    ship_package(frames.sparkSession)
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (px,) in stacks(batch, ["px"], STACK):
                for made in function(px, *(batch.column(c).take(pa.array(rows)) for c in own)):
                    keys = batch.column("f").take(pa.array(rows[made["frame"]]))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.ascontiguousarray(made[c]), kinds[k]) for c, k in columns.items())], names=["f", *columns])

    given = frames.where("f is not null").select(F.col("f").cast("long").alias("f"), "w", "h", F.col("px").cast("array<double>").alias("px"), *own)
    return given.mapInArrow(run, ", ".join(["f long", *(f"{c} {k}" for c, k in columns.items())]))
