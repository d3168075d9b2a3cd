"""Event time of reports: the devices' 32-bit clocks unwrapped, counted in windows, late reports apart.

A device's clock starts anew every 2^32 ticks, and at a reset. What it has counted so far is keyed state, and so are the counts of its open windows.
Each device has a watermark of its own, its newest tick less the lateness that is allowed: clocks of two devices have nothing to do
with each other, and a slow device loses nothing to a fast one. A window is given out, once, when the watermark
has passed its end; a report for a window that was given out is late, and comes out as such: every report is counted once, in
a window or as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tactigrid.session import ship_package
from tactigrid.sources import capture
from tactigrid.streaming.live import needs_rocks, placed

WRAP = 1 << 32
#: kind: `window` (n reports from `start` on) or `late` (one report; start is that of its window). Ticks since the device's first report, plus that report's own.
OUTPUT = "device string, kind string, start long, n long, epoch long, number long, pos long, ticks long"
#: Of a device's reports.
ORDER = ["epoch", "number", "pos"]
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def clock_reports(buffers: DataFrame) -> DataFrame:
    """Timestamp reports of buffers (path, content): device, epoch, number, pos, raw."""
    return placed(capture.timestamps(capture.reports(buffers))).select("device", "epoch", "number", "pos", F.col("timestamp").alias("raw"))


class WindowCounter(StatefulProcessor):
    def __init__(self, width: int, lateness: int, ordered: bool = False) -> None:
        self.width, self.lateness, self.ordered = width, lateness, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "epoch long, raw long, ticks long, newest long")
        self.open = handle.getMapState("open", "start long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.clock.get() if self.clock.exists() else None
        epoch, last, ticks, newest = state or (None, 0, 0, 0)
        counts = {k[0]: v[0] for k, v in self.open.iterator()}
        kept, out = set(counts), []
        # A table's rows come in order; a micro-batch's don't, and a device's may come in several parts of it.
        parts = rows if self.ordered else [pd.concat(list(rows)).sort_values(ORDER)]
        for batch in parts:
            for r in batch.itertuples(index=False):
                if epoch is None:
                    ticks = newest = r.raw
                elif r.epoch > epoch:  # a reset: the new clock begins where the old one had come to
                    ticks = newest + r.raw
                else:
                    ticks += (r.raw - last + WRAP // 2) % WRAP - WRAP // 2
                epoch, last = max(r.epoch, epoch or 0), r.raw
                start = ticks // self.width * self.width
                if start + self.width <= newest - self.lateness:
                    out.append((key[0], "late", start, 1, r.epoch, r.number, r.pos, ticks))
                    continue
                counts[start] = counts.get(start, 0) + 1
                newest = max(newest, ticks)
                for done in sorted(k for k in counts if k + self.width <= newest - self.lateness):
                    out.append((key[0], "window", done, counts.pop(done), None, None, None, None))
        for gone in kept - set(counts):
            self.open.removeKey((gone,))
        for start, n in counts.items():
            self.open.updateValue((start,), (n,))
        self.clock.update((epoch, last, ticks, newest))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({c: "Int64" for c in ("epoch", "number", "pos", "ticks")})


def windows(buffers: DataFrame, width: int, lateness: int) -> DataFrame:
    """Closed windows and late reports of a stream (or table) of buffers; see OUTPUT. Open windows stay in the state."""
    needs_rocks(buffers.sparkSession)
    ship_package(buffers.sparkSession)
    found, ordered = clock_reports(buffers), not buffers.isStreaming
    if ordered:  # a device of a table may have more reports than one batch holds: Spark sorts them, and deals them as the state asks for
        found = found.repartition(int(buffers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "device").sortWithinPartitions("device", *ORDER)
    return found.groupBy("device").transformWithStateInPandas(WindowCounter(width, lateness, ordered), OUTPUT, "Append", "None")


def start(buffers: DataFrame, sink: str, checkpoint: str, width: int, lateness: int, **trigger):
    """windows/ and late/ of every micro-batch; one that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.where("kind = 'window'").select("device", "start", "n").write.mode("overwrite").parquet(f"{sink}/windows/batch={number}")
        held.where("kind = 'late'").drop("kind", "n").write.mode("overwrite").parquet(f"{sink}/late/batch={number}")
        held.unpersist()

    return windows(buffers, width, lateness).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
