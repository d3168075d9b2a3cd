"""Many devices as one stream, read by the executors, with their life cycle.

A device is a folder: `doorbell` (a count of buffers written so far), `buffer_0` .. `buffer_15` (buffer n is in place n modulo 16), `ready`
(1 when it can be asked; absent: always), `info` (JSON: vendor, product, version, buffer_size) and `feedback` (what the reader
has done with). The source's folder is a device, or holds devices. The driver reads doorbells only; buffers are read by tasks,
`buffers_per_task` each. What a device calls for is done in this order:

* a stream that starts at `latest` flushes a device (feedback for all its buffers) and begins at its doorbell; one that starts at `earliest` begins at 0;
* before a doorbell is read, the reader waits for the device to be ready, `ready_attempts` (5) times `ready_pause` (1) seconds at most; a
  device that isn't ready then has no news in this batch, the others have;
* a doorbell below the last one tells of a reset: the device is flushed, and goes on from 0 in a new epoch;
* a buffer is whole if the doorbell read after it shows that its place can't have been written again; else, and if it is replayed after a restart that came
  too late, the row has no content, which `capture.diagnostics` reports;
* feedback is sent when a batch is committed, never before.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RING = 16


@dataclass(frozen=True)
class Device:
    folder: Path

    def number(self, name: str) -> int | None:
        try:
            return int((self.folder / name).read_text())
        except (FileNotFoundError, ValueError):
            return None

    def doorbell(self) -> int:
        return self.number("doorbell") or 0

    def wait(self, attempts: int, pause: float) -> bool:
        """Whether the device is ready, after so many attempts at most."""
        for k in range(attempts):
            if not (self.folder / "ready").exists() or (self.number("ready") or 0) > 0:
                return True
            if k + 1 < attempts:
                time.sleep(pause)
        return False

    def info(self) -> dict:
        try:
            return json.loads((self.folder / "info").read_text())
        except (FileNotFoundError, ValueError):
            return {}

    def feedback(self, count: int) -> None:
        (self.folder / "feedback").write_text(str(count))

    def flush(self) -> None:
        """Feedback for all buffers, whatever they hold."""
        (self.folder / "flushed").write_text(str((self.number("flushed") or 0) + RING))

    def buffer(self, n: int, most: int | None) -> bytes | None:
        """Buffer n; None if it has been, or may have been, written over."""
        try:
            content = (self.folder / f"buffer_{n % RING}").read_bytes()
        except FileNotFoundError:
            return None
        now = self.doorbell()
        return content[:most] if n < now <= n + RING else None


def devices(folder: Path) -> dict[str, Device]:
    """By name: the folder itself, or those in it."""
    if (folder / "doorbell").exists():
        return {folder.name: Device(folder)}
    return {p.name: Device(p) for p in sorted(folder.iterdir()) if (p / "doorbell").exists()} if folder.is_dir() else {}


@dataclass
class Buffers(InputPartition):
    device: str
    epoch: int
    low: int
    high: int
    #: Whether this is still the epoch of the device as it was when the batch was planned.
    current: bool


class DevicesReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = Path(options["path"])
        self.latest = options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "latest"
        self.attempts, self.pause = int(options.get("ready_attempts", 5)), float(options.get("ready_pause", 1))
        self.per_task = int(options.get("buffers_per_task", 8))
        self.last: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        begun = {}
        if self.latest:
            for name, device in devices(self.folder).items():
                if device.wait(self.attempts, self.pause):
                    device.flush()
                    begun[name] = [0, device.doorbell()]
        return begun

    def latestOffset(self) -> dict:  # noqa: N802
        """[epoch, doorbell] of every device that there is, or was."""
        if self.last is None:
            self.last = self.initialOffset()
        now = dict(self.last)
        for name, device in devices(self.folder).items():
            if not device.wait(self.attempts, self.pause):
                continue
            epoch, count = now.get(name, [0, 0])
            rung = device.doorbell()
            if rung < count:
                device.flush()
                epoch += 1
            now[name] = [epoch, rung]
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Buffers]:
        """Ranges of buffers; after a restart the reader goes on from what the stream has planned last."""
        if self.last is None or any(self.last.get(k, [0, 0]) < v for k, v in end.items()):
            self.last = {**(self.last or {}), **end}
        found = []
        for name, (epoch, high) in end.items():
            first, low = start.get(name, [0, 0])
            if first != epoch:
                low = 0
            current = self.last.get(name, [epoch])[0] == epoch
            found += [Buffers(name, epoch, k, min(k + self.per_task, high), current) for k in range(low, high, self.per_task)]
        return found

    def read(self, partition: Buffers) -> Iterator[tuple[str, bytes | None]]:
        device = devices(self.folder).get(partition.device)
        most = device.info().get("buffer_size") if device else None
        for n in range(partition.low, partition.high):
            yield f"{partition.device}/{partition.epoch}/{n}", device.buffer(n, most) if device and partition.current else None

    def commit(self, end: dict) -> None:
        there = devices(self.folder)
        for name, (_, count) in end.items():
            if name in there:
                there[name].feedback(count)

    def stop(self) -> None:
        """What was committed has its feedback; what wasn't stays in the ring for the next start."""


class DevicesSource(DataSource):
    """format("tactigrid-devices"): see the module. Options: path, startingOffsets (earliest, latest), ready_attempts, ready_pause, buffers_per_task."""

    @classmethod
    def name(cls) -> str:
        return "tactigrid-devices"

    def schema(self) -> str:
        return "path string, content binary"

    def streamReader(self, schema):  # noqa: ANN001, ANN201, N802
        return DevicesReader(self.options)


class _InfoReader(DataSourceReader):
    def __init__(self, folder: Path) -> None:
        self.folder = folder

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name, device in devices(self.folder).items():
            info = device.info()
            yield (name, *(None if info.get(k) is None else int(info[k]) for k in ("vendor", "product", "version", "buffer_size")), device.doorbell(), device.number("feedback"))


class InfoSource(DataSource):
    """format("tactigrid-device-info"): a row for each device of a folder."""

    @classmethod
    def name(cls) -> str:
        return "tactigrid-device-info"

    def schema(self) -> str:
        return "device string, vendor long, product long, version long, buffer_size long, doorbell long, feedback long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _InfoReader(Path(self.options["path"]))
