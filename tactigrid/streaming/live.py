"""Heatmaps of live devices: what a parser remembers between buffers, as keyed state.

A device sends its dimensions now and then, and its buffers hold heatmaps that rely on those sent before. Buffers arrive as rows
(path `device/epoch/number`, content) in micro-batches. They are decoded where they are; only dimensions and heatmaps are dealt by device to
a stateful operator, which keeps eight bytes of dimensions, the last place seen and the number of frames for each device, and forgets a
device that was silent for long. The state is Spark's (checkpointed, restored at a restart), so a stream that is
stopped anywhere goes on as if it had been one parser all along.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tactigrid.operators import fit
from tactigrid.session import ship_package
from tactigrid.sources import capture

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: note is null for frames; else what became of the report, or of the device's state.
OUTPUT = "device string, epoch long, number long, pos long, f long, w int, h int, z_min int, z_max int, payload binary, note string"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def placed(found: DataFrame) -> DataFrame:
    """Rows of captures named `device/epoch/number`, with these three."""
    pattern = r"^(.*)/(\d+)/(\d+)$"
    numbers = {c: F.regexp_extract("capture", pattern, k).try_cast("long") for k, c in ((2, "epoch"), (3, "number"))}
    return found.withColumns({"device": F.regexp_extract("capture", pattern, 1), **numbers})


def buffer_reports(buffers: DataFrame) -> DataFrame:
    """Dimensions and heatmaps of buffers (path, content): device, epoch, number, pos, report_type, payload."""
    found = capture.reports(buffers).where(F.col("report_type").isin(capture.DIMENSIONS, capture.HEATMAP))
    return placed(found).select("device", "epoch", "number", "pos", "report_type", "payload")


def needs_rocks(spark: SparkSession) -> None:
    """The RocksDB state store, for a session that names none; and the coordinator of state stores, which a table needs too."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_STORE):
        spark.conf.set(_STORE, _ROCKS)
    spark.streams.active  # noqa: B018  starts the coordinator


class FrameAssembler(StatefulProcessor):
    """Of one device: heatmaps with the dimensions last seen before them, in whichever buffer and micro-batch."""

    def __init__(self, idle_seconds: float | None) -> None:
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "epoch long, number long, pos long, frames long, dims string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.last.get() if self.last.exists() else None
        epoch, number, pos, frames, dims = state or (-1, -1, -1, 0, "")
        size = bytes.fromhex(dims)
        for batch in rows:
            out = []
            for r in batch.sort_values(["epoch", "number", "pos"]).itertuples(index=False):
                place, payload = (r.epoch, r.number, r.pos), bytes(r.payload)
                note = None
                if place <= (epoch, number, pos):
                    note = "late: its place has been passed"
                elif r.report_type == capture.DIMENSIONS:
                    epoch, number, pos = place
                    if len(payload) >= 8:
                        size = payload[:8]
                        continue
                    note = "dimensions are cut"
                else:
                    epoch, number, pos = place
                    if not size:
                        note = "no dimensions yet"
                    elif len(payload) != size[0] * size[1]:
                        note = f"{len(payload)} cells, {size[1]} x {size[0]} expected"
                shape = (size[1], size[0], size[6], size[7]) if size else (None,) * 4
                out.append((r.device, *place, None if note else frames, *shape, None if note else payload, note))
                frames += not note
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"f": "Int64", "w": "Int32", "h": "Int32", "z_min": "Int32", "z_max": "Int32"})
        self.last.update((epoch, number, pos, frames, size.hex()))
        if self.idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((time.time() + self.idle) * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        epoch, number, pos, frames, dims = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], epoch, number, pos, None, None, None, None, None, None, f"forgotten after {frames} frames")], columns=_COLUMNS).astype({"f": "Int64", "w": "Int32", "h": "Int32", "z_min": "Int32", "z_max": "Int32"})


def assembled(buffers: DataFrame, idle_seconds: float | None = None, across_resets: bool = True) -> DataFrame:
    """Frames and notes of a stream (or table) of buffers; see OUTPUT. f counts a device's frames.

    across_resets: dimensions outlive a reset of the device (a new epoch), as they do in a parser that is never made anew; else
    every epoch has a state, and numbers, of its own. idle_seconds: after so long without a buffer, a device is forgotten; its
    timers make batches of their own, so that such a query never ends by itself, whatever its trigger.
    The operator needs the RocksDB state store; a session that names no store gets it.
    """
    spark = buffers.sparkSession
    ship_package(spark)
    needs_rocks(spark)
    keys = ["device"] if across_resets else ["device", "epoch"]
    given = buffer_reports(buffers)
    return given.groupBy(*keys).transformWithStateInPandas(FrameAssembler(idle_seconds), OUTPUT, "Append", "None" if idle_seconds is None else "ProcessingTime")


def frames(found: DataFrame) -> DataFrame:
    """Dense frames (capture, f, pos, w, h, px) of what `assembled` found; capture names the buffer."""
    named = F.concat_ws("/", "device", "epoch", "number").alias("capture")
    return capture.scaled(found.where("note is null").select(named, "f", "pos", "w", "h", F.col("z_min").alias("low"), F.col("z_max").alias("high"), "payload"))


def notes(found: DataFrame) -> DataFrame:
    return found.where("note is not null").select("device", "epoch", "number", "pos", "note")


def start(buffers: DataFrame, sink: str, checkpoint: str, idle_seconds: float | None = None, **trigger):
    """Contacts (touches/) and notes (notes/) of every micro-batch; one that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        fit.touch_points(frames(held).select("capture", "f", "w", "h", "px"), ("capture",)).write.mode("overwrite").parquet(f"{sink}/touches/batch={number}")
        notes(held).write.mode("overwrite").parquet(f"{sink}/notes/batch={number}")
        held.unpersist()

    return assembled(buffers, idle_seconds).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
