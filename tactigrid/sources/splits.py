"""Large captures read by many tasks, and files written by many tasks.

A capture's records have no marks to begin reading at, only sizes in their headers. `record_splits` walks the headers of
the outermost records, 64 bytes of each, one task a file, and cuts a file after whole records into ranges of about
`split_bytes`; `read_splits` deals the ranges to all tasks, which read only their own. Files are opened by pyarrow, where they are: local
folders and the stores that pyarrow knows. For other stores there is `capture.read_captures`, which needs Spark's reader only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tactigrid.session import ship_package
from tactigrid.sources.capture import DATA


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if local := re.fullmatch(r"(?:file:(?://(?=/))?)?(/.*)", uri):
        return pafs.LocalFileSystem(), local[1]
    return pafs.FileSystem.from_uri(uri)


def _ranges(source: pa.NativeFile, size: int, split_bytes: int, buffer_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ends of ranges: after whole records; what follows a cut record, or less than a header, belongs to the last range."""
    begin = pos = held_at = 0
    held = b""
    while pos + DATA.size <= size:
        if not held_at <= pos <= held_at + len(held) - DATA.size:
            source.seek(pos)
            held, held_at = source.read(min(buffer_bytes, size - pos)), pos
        stop = pos + DATA.size + DATA.unpack_from(held, pos - held_at)[1]
        if stop > size:
            break
        pos = stop
        if pos - begin >= split_bytes and pos < size:
            yield begin, pos
            begin = pos
    if begin < size or not size:
        yield begin, size


def record_splits(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """path, start, stop: ranges of whole records of every file."""
    ship_package(spark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                store, inner = store_of(name)
                with store.open_input_file(inner) as source:
                    starts, stops = zip(*_ranges(source, size, split_bytes), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts)), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["path", "start", "stop"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents aren't read
    return files.repartition("path").mapInArrow(walk, "path string, start long, stop long")


def read_splits(splits: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, start, content of every range, for `capture.reports` and `capture.diagnostics`; dealt to so many tasks (by default one for each shuffle partition)."""
    spark = splits.sparkSession
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
                store, inner = store_of(name)
                with store.open_input_file(inner) as source:
                    source.seek(start)
                    content = source.read(stop - start)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([start], pa.int64()), pa.array([content], pa.binary())], names=["path", "start", "content"])

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(tasks, "path", "start").mapInArrow(read, "path string, start long, content binary")


class FileSink(DataSource):
    """format("tactigrid-files"): rows (path, content) as files under the folder that save() names.

    Tasks write to a folder beside it; the commit renames that folder, so all files are there or none. A job that fails, or is stopped,
    leaves nothing under the name. mode("overwrite") replaces the folder at the commit, "append" moves the files into it.
    """

    @classmethod
    def name(cls) -> str:
        return "tactigrid-files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return FileWriter(self.options["path"], overwrite)


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        import uuid

        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.staging = f"{self.folder}.writing-{uuid.uuid4().hex}"

    def encoded(self, row) -> tuple[str, bytes]:  # noqa: ANN001
        """Name and bytes of a row's file."""
        return row["path"], bytes(row["content"])

    def write(self, rows) -> WriterCommitMessage:  # noqa: ANN001
        import os
        import uuid

        store, staging = store_of(self.staging)
        store.create_dir(staging, recursive=True)
        for row in rows:
            name, content = self.encoded(row)
            target = os.path.normpath(f"{staging}/{name}")
            if not target.startswith(f"{staging}/"):
                raise ValueError(f"{name} is outside the folder")
            store.create_dir(os.path.dirname(target), recursive=True)
            own = f"{target}.{uuid.uuid4().hex}"  # two attempts of a task never write to one file
            with store.open_output_stream(own) as out:
                out.write(content)
            store.move(own, target)
        return WriterCommitMessage()

    def commit(self, messages) -> None:  # noqa: ANN001
        store, staging = store_of(self.staging)
        folder = store_of(self.folder)[1]
        there = store.get_file_info(folder).type != pafs.FileType.NotFound
        if there and self.overwrite:
            store.delete_dir(folder)
        if not there or self.overwrite:
            store.move(staging, folder)
            return
        for info in store.get_file_info(pafs.FileSelector(staging, recursive=True)):
            if info.type == pafs.FileType.File:
                target = folder + info.path[len(staging) :]
                store.create_dir(target.rpartition("/")[0], recursive=True)
                store.move(info.path, target)
        store.delete_dir(staging)

    def abort(self, messages) -> None:  # noqa: ANN001
        store, staging = store_of(self.staging)
        if store.get_file_info(staging).type != pafs.FileType.NotFound:
            store.delete_dir(staging)
