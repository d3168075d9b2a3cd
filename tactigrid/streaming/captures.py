"""Streams of captures: a folder of files, or a device with a doorbell and a ring of buffers."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tactigrid.operators import fit
from tactigrid.sources import capture
from tactigrid.session import ship_package

RING = 16
_FILE_COLUMNS = "path string, modificationTime timestamp, length long, content binary"


def read_folder(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Stream of (path, content), each file once."""
    stream = spark.readStream.format("binaryFile").schema(_FILE_COLUMNS).option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.select("path", "content")


def process_batch(captures: DataFrame) -> DataFrame:
    """Captures of a micro-batch to contacts: capture, f (number of the frame in its capture) and the columns of touch_points."""
    found = capture.heatmaps(capture.reports(captures)).select("capture", "f", "w", "h", "px")
    return fit.touch_points(found, ("capture",))


def start(stream: DataFrame, sink: str, checkpoint: str, **trigger):
    """Runs process_batch on every micro-batch; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        process_batch(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


class DeviceSource(DataSource):
    """format("tactigrid-device"): a folder with `doorbell` (a count) and buffer_0 .. buffer_15.

    The offset is the doorbell; buffer number n % 16 holds what doorbell n announced. A doorbell below the stored one means
    that the device was reset: the stream goes on from 0 in a new epoch. Committed offsets are written to `feedback`. A buffer that was
    overwritten before it was read is a row without content, which `capture.diagnostics` reports.
    """

    @classmethod
    def name(cls) -> str:
        return "tactigrid-device"

    def schema(self) -> str:
        return "path string, content binary"

    def simpleStreamReader(self, schema):  # noqa: N802, ANN001
        return DeviceReader(Path(self.options["path"]))


class DeviceReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: Path) -> None:
        self.folder = folder

    def _doorbell(self) -> int:
        try:
            return int((self.folder / "doorbell").read_text())
        except (FileNotFoundError, ValueError):
            return 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"epoch": 0, "count": 0}

    def _rows(self, epoch: int, low: int, high: int) -> Iterator[tuple[str, bytes | None]]:
        for n in range(low, high):
            content = None  # older buffers have been overwritten: the row tells that they were missed
            if n >= high - RING:
                try:
                    content = (self.folder / f"buffer_{n % RING}").read_bytes()
                except FileNotFoundError:
                    pass
            yield f"device/{epoch}/{n}", content

    def read(self, start: dict) -> tuple[Iterator[tuple[str, bytes]], dict]:
        now = self._doorbell()
        epoch, low = (start["epoch"], start["count"]) if now >= start["count"] else (start["epoch"] + 1, 0)
        return iter(list(self._rows(epoch, low, now))), {"epoch": epoch, "count": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str, bytes]]:  # noqa: N802
        return self._rows(end["epoch"], start["count"] if start["epoch"] == end["epoch"] else 0, end["count"])

    def commit(self, end: dict) -> None:
        (self.folder / "feedback").write_text(str(end["count"]))


def _strokes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    down, stroke, seq, opened = state.get if state.exists else (False, 0, 0, False)
    for batch in batches:
        rows = []
        for r in batch.sort_values("pos").itertuples():
            now = (r.mode & 3) == 3
            if now:
                if not down:
                    stroke, seq, opened = stroke + 1, 0, True
                rows.append((*key, stroke, seq, r.pos, r.x, r.y))
                seq += 1
            down = now
        yield pd.DataFrame(rows, columns=["capture", "kind", "stroke_id", "seq", "pos", "x", "y"])
    state.update((down, stroke, seq, opened))


def stream_strokes(samples: DataFrame) -> DataFrame:
    """Strokes of a stream of samples (capture, kind, pos, mode, x, y); the open stroke of each pen is the state."""
    ship_package(samples.sparkSession)
    return samples.groupBy("capture", "kind").applyInPandasWithState(
        _strokes, "capture string, kind string, stroke_id int, seq int, pos long, x int, y int", "down boolean, stroke int, seq int, opened boolean", "append", GroupStateTimeout.NoTimeout
    )

