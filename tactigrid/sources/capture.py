"""Captures: nested length-prefixed records, decoded to report rows and typed views.

Decoding one capture is sequential, so captures are read in parallel by file; everything after the report rows is
columns. Sizes in headers exclude the header. Unknown types are skipped by their length and counted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactigrid.session import checkpointed, ship_package

# Fixed values of the format.
DATA, PAYLOAD, FRAME, REPORT = struct.Struct("<III52x"), struct.Struct("<II4x"), struct.Struct("<HHI8x"), struct.Struct("<HH")
DATA_PAYLOAD = 0x00
REPORT_FRAMES = (0x06, 0x07, 0x08)
TIMESTAMP, DIMENSIONS, HEATMAP, STYLUS_SERIAL, STYLUS = 0x400, 0x403, 0x425, 0x460, 0x461
SAMPLE_BYTES = 16
SAMPLE_FIELDS = ("timestamp", "mode", "x", "y", "pressure", "altitude", "azimuth")
#: Reports that are known to exist and kept raw.
RAW_REPORTS = (0x033, 0x402, 0x404, 0x406, 0x407, 0x432, 0x4FF, 0x800, 0x803, 0x804, 0x806, 0x807, 0x812, 0x8FF)
LEVELS = {"DBG": 0, "INFO": 1, "WARN": 2, "ERR": 3}
#: Bytes before the samples of a report.
_SAMPLE_HEADS = {STYLUS: 4, STYLUS_SERIAL: 8}
_KNOWN = {TIMESTAMP, DIMENSIONS, HEATMAP, STYLUS_SERIAL, STYLUS, *RAW_REPORTS}
_REPORT_COLUMNS = "capture string, pos long, buffer long, counter long, frame_index int, frame_type int, report_type int, payload binary"
_DIAGNOSTIC_COLUMNS = "capture string, pos long, level int, kind string, type int, message string"


class TruncatedCapture(ValueError):
    """A record is longer than what is left."""


def _cut_samples(kind: int, payload: bytes) -> str | None:
    """What a report of pen samples promises and doesn't hold."""
    head = _SAMPLE_HEADS[kind]
    there, promised = max(0, len(payload) - head) // SAMPLE_BYTES, payload[0] if payload else 0
    if not payload or len(payload) < head:
        return "header of samples is cut"
    return f"{promised - there} of {promised} samples are missing" if there < promised else None


def walk(content: bytes, oneshot: bool = False, strict: bool = False) -> Iterator[tuple]:
    """("report", pos, buffer, counter, frame index, frame type, report type, payload) and ("note", pos, level, kind, type, message)."""

    def records(header: struct.Struct, start: int, end: int, kind: str, size_field: int, most: int | None = None) -> Iterator[tuple]:
        pos, read = start, 0
        while pos + header.size <= end:
            if read == most:
                return
            read += 1
            fields = header.unpack_from(content, pos)
            stop = pos + header.size + fields[size_field]
            if stop > end:
                if strict:
                    raise TruncatedCapture(f"{kind} record at {pos} ends at {stop}, {end} bytes are there")
                yield pos, None, f"{kind} record is cut: {stop - end} bytes are missing", stop
                return
            yield pos, fields, pos + header.size, stop
            pos = stop
        if pos < end and read != most:
            yield pos, None, f"{end - pos} bytes after the last {kind} record", end

    for pos, data, body, stop in records(DATA, 0, len(content), "data", 1):
        if data is None:
            yield "note", pos, LEVELS["ERR"], "data", None, body
            continue
        if data[0] != DATA_PAYLOAD:
            yield "note", pos, LEVELS["WARN"], "data", data[0], "unknown type"
        elif stop - body < PAYLOAD.size:
            if strict:
                raise TruncatedCapture(f"payload at {body}")
            yield "note", body, LEVELS["ERR"], "payload", None, "payload header is cut"
        else:
            counter, promised = PAYLOAD.unpack_from(content, body)
            found, read_to = 0, body + PAYLOAD.size
            for fpos, frame, fbody, fstop in records(FRAME, read_to, stop, "frame", 2, promised):
                if frame is None:
                    yield "note", fpos, LEVELS["ERR"], "frame", None, fbody
                    read_to = stop
                    continue
                found, read_to = found + 1, fstop
                if frame[1] not in REPORT_FRAMES:
                    yield "note", fpos, LEVELS["WARN"], "frame", frame[1], "unknown type"
                else:
                    for rpos, report, rbody, rstop in records(REPORT, fbody, fstop, "report", 1):
                        if report is None:
                            yield "note", rpos, LEVELS["ERR"], "report", None, rbody
                            continue
                        if report[0] not in _KNOWN:
                            yield "note", rpos, LEVELS["WARN"], "report", report[0], "unknown type"
                        if report[0] in _SAMPLE_HEADS and (told := _cut_samples(report[0], content[rbody:rstop])):
                            yield "note", rpos, LEVELS["ERR"], "samples", None, told
                        yield "report", rpos, data[2], counter, frame[0], frame[1], report[0], content[rbody:rstop]
            if found < promised:
                if strict:
                    raise TruncatedCapture(f"payload at {body} has {found} of {promised} frames")
                yield "note", body, LEVELS["ERR"], "payload", None, f"{promised - found} of {promised} frames are missing"
            elif read_to < stop:
                yield "note", read_to, LEVELS["WARN"], "payload", None, f"{stop - read_to} bytes after the last of {promised} frames"
        if oneshot:
            return


def _decoded(captures: DataFrame, wanted: str, schema: str, oneshot: bool, strict: bool) -> DataFrame:
    ship_package(captures.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lost = ("note", 0, LEVELS["ERR"], "data", None, "nothing was read")
                rows = [(name, start + r[1], *r[2:]) for r in ([lost] if content is None else walk(content, oneshot, strict)) if r[0] == wanted]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    start = F.col("start").cast("long") if "start" in captures.columns else F.lit(0).cast("long")  # of a part of a file
    return captures.select(F.col("path").alias("capture"), start.alias("start"), "content").mapInArrow(run, schema)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file; any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def reports(captures: DataFrame, oneshot: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """Report rows. mode FAILFAST fails on cut records, PERMISSIVE leaves them out (see `diagnostics`)."""
    return _decoded(captures, "report", _REPORT_COLUMNS, oneshot, mode == "FAILFAST")


def diagnostics(captures: DataFrame, level: str = "INFO") -> DataFrame:
    """Messages of at least a level; unknown types have their kind and number."""
    return _decoded(captures, "note", _DIAGNOSTIC_COLUMNS, False, False).where(F.col("level") >= LEVELS[level])


def unknown_types(captures: DataFrame) -> DataFrame:
    return diagnostics(captures).where("type is not null").groupBy("kind", "type").count()


def byte(payload: Column, at: int | Column) -> Column:
    """Unsigned byte at an offset, as int."""
    return F.conv(F.hex(F.substring(payload, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(1))), 16, 10).cast("int")


def u16(payload: Column, at: int | Column) -> Column:
    return byte(payload, at) + 256 * byte(payload, at + 1)


def u32(payload: Column, at: int | Column) -> Column:
    return u16(payload, at).cast("long") + 65536 * u16(payload, at + 2).cast("long")


def timestamps(found: DataFrame) -> DataFrame:
    """Both kinds of timestamp report: the current one and the one of the raw reports."""
    p = F.col("payload")
    return found.where(F.col("report_type").isin(TIMESTAMP, 0x800)).select("capture", "pos", u16(p, 2).alias("counter"), u32(p, 4).alias("timestamp"))


_DIM_FIELDS = ("height", "width", "y_min", "y_max", "x_min", "x_max", "z_min", "z_max")


def dimensions(found: DataFrame) -> DataFrame:
    """Of dimension reports, and of their raw form."""
    return found.where(F.col("report_type").isin(DIMENSIONS, 0x803)).select("capture", "pos", *(byte(F.col("payload"), i).alias(n) for i, n in enumerate(_DIM_FIELDS)))


def counters(found: DataFrame) -> DataFrame:
    """The counter that reports of type 0x4ff hold."""
    return found.where(F.col("report_type") == 0x4FF).select("capture", "pos", u32(F.col("payload"), 0).alias("counter"))


def heatmaps(found: DataFrame) -> DataFrame:
    """Dense frames (capture, f, pos, w, h, px): each heatmap with the dimensions last seen before it, 1 = strong contact.

    Heatmaps before any dimensions, or with another number of cells, are left out.
    """
    dim = F.when(F.col("report_type") == DIMENSIONS, F.struct(*(byte(F.col("payload"), i).alias(n) for i, n in enumerate(_DIM_FIELDS))))
    order = Window.partitionBy("capture").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = found.where(F.col("report_type").isin(DIMENSIONS, HEATMAP)).withColumn("dim", F.last(dim, ignorenulls=True).over(order)).where((F.col("report_type") == HEATMAP) & F.col("dim").isNotNull())
    d = d.where(F.length("payload") == F.col("dim.width") * F.col("dim.height"))
    number = F.row_number().over(Window.partitionBy("capture").orderBy("pos")) - 1
    return scaled(d.select("capture", number.cast("long").alias("f"), "pos", F.col("dim.width").alias("w"), F.col("dim.height").alias("h"), F.col("dim.z_min").alias("low"), F.col("dim.z_max").alias("high"), "payload"))


def heatmaps_in_ranges(found: DataFrame) -> DataFrame:
    """The same of captures of any size: reports are dealt by range of (capture, pos); a row for each capture and range carries its last
    dimensions and its number of frames to the ranges after it."""
    dim = F.when(F.col("report_type") == DIMENSIONS, F.struct(*(byte(F.col("payload"), i).alias(n) for i, n in enumerate(_DIM_FIELDS))))
    own = found.where(F.col("report_type").isin(DIMENSIONS, HEATMAP)).select("capture", "pos", dim.alias("dim"), F.when(F.col("report_type") == HEATMAP, F.col("payload")).alias("payload"))
    dealt = checkpointed(own.repartitionByRange("capture", "pos").withColumn("range_", F.spark_partition_id()))
    before = Window.partitionBy("capture").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    lasts = dealt.groupBy("capture", "range_").agg(F.max_by("dim", F.when(F.col("dim").isNotNull(), F.col("pos"))).alias("last"))
    carried = lasts.select("capture", "range_", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("range_", "capture").orderBy("pos")
    d = dealt.join(carried, ["capture", "range_"]).withColumn("dim", F.coalesce(F.last("dim", ignorenulls=True).over(within), "carried"))
    d = checkpointed(d.where(F.col("payload").isNotNull() & (F.length("payload") == F.col("dim.width") * F.col("dim.height"))).drop("carried"))
    counts = d.groupBy("capture", "range_").agg(F.count("*").alias("n"))
    bases = counts.select("capture", "range_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_"))
    numbered = d.withColumn("row_", F.row_number().over(within)).join(bases, ["capture", "range_"]).withColumn("f", (F.col("base_") + F.col("row_") - 1).cast("long"))
    return scaled(numbered.select("capture", "f", "pos", F.col("dim.width").alias("w"), F.col("dim.height").alias("h"), F.col("dim.z_min").alias("low"), F.col("dim.z_max").alias("high"), "payload"))


def scaled(found: DataFrame) -> DataFrame:
    """capture, f, pos, w, h, low, high, payload to dense frames: low is 1, high is 0."""
    ship_package(found.sparkSession)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            sizes = np.array([len(p) for p in payloads], np.int64)
            low, high = (batch.column(c).to_numpy().astype(float) for c in ("low", "high"))
            cells = 1 - (np.frombuffer(b"".join(payloads), np.uint8) - np.repeat(low, sizes)) / np.repeat(np.where(high > low, high - low, 1.0), sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            keys = ["capture", "f", "pos", "w", "h"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells))], names=[*keys, "px"])

    return found.mapInArrow(scale, "capture string, f long, pos long, w int, h int, px array<double>")


def stylus(found: DataFrame) -> DataFrame:
    """Samples: capture, pos, kind (serial or plain), serial, elements, idx, timestamp, mode, x, y, pressure, altitude, azimuth."""
    p, has = F.col("payload"), F.col("report_type") == STYLUS_SERIAL
    d = found.where(F.col("report_type").isin(STYLUS_SERIAL, STYLUS)).select("capture", "pos", "payload", F.when(has, "serial").otherwise("plain").alias("kind"), F.when(has, u32(p, 4)).alias("serial"), byte(p, 0).alias("elements"), F.when(has, 8).otherwise(4).alias("head"))
    whole = F.least(F.col("elements"), F.expr(f"(length(payload) - head) div {SAMPLE_BYTES}").cast("int"))
    d = d.withColumn("n", whole).where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    at = F.col("head") + F.col("idx") * SAMPLE_BYTES
    return d.select("capture", "pos", "kind", "serial", "elements", "idx", *(u16(F.col("payload"), at + 2 * i).alias(n) for i, n in enumerate(SAMPLE_FIELDS)))


def _record(number: int, w: int, h: int, cells: bytes, announce: bool) -> bytes:
    """One data record with a heatmap; announce: and its dimensions before it."""
    body = REPORT.pack(DIMENSIONS, 8) + bytes((h, w, 0, h - 1, 0, w - 1, 0, 255)) if announce else b""
    body += REPORT.pack(HEATMAP, len(cells)) + cells
    frame = FRAME.pack(0, REPORT_FRAMES[0], len(body)) + body
    return DATA.pack(DATA_PAYLOAD, PAYLOAD.size + len(frame), 0) + PAYLOAD.pack(number & 0xFFFFFFFF, 1) + frame


def _encode(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("f")
    out, size = [], None
    for r in group.itertuples():
        out.append(_record(int(r.f), int(r.w), int(r.h), bytes(int(v) for v in r.px), (r.w, r.h) != size))
        size = (r.w, r.h)
    return pd.DataFrame({"path": [f"capture-{int(group['part'].iloc[0]):08d}"], "content": [b"".join(out)]})


def encode_buffers(frames: DataFrame) -> DataFrame:
    """Frames of devices (device, epoch, number, w, h, px of whole numbers 0..255, announce) to buffers (path, content), one each.

    Only buffers with `announce` say their dimensions, as devices do now and then.
    """
    ship_package(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            paths = [f"{r['device']}/{r['epoch']}/{r['number']}" for r in rows]
            contents = [_record(r["number"], r["w"], r["h"], bytes(r["px"]), r["announce"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return frames.select("device", "epoch", "number", "w", "h", "px", "announce").mapInArrow(run, "path string, content binary")


def encode_frames(frames: DataFrame, per_capture: int = 64) -> DataFrame:
    """Dense frames of whole numbers 0..255 (f, w, h, px) to captures (path, content): each starts with its dimensions.

    A capture holds `per_capture` successive frame numbers.
    """
    ship_package(frames.sparkSession)
    keyed = frames.select("f", "w", "h", "px", F.expr(f"f div {per_capture}").alias("part"))
    return keyed.groupBy("part").applyInPandas(_encode, "path string, content binary")


def _encode_samples(group: pd.DataFrame) -> pd.DataFrame:
    out = []
    for number, (_, rows) in enumerate(group.sort_values(["report", "idx"]).groupby("report", sort=True)):
        samples = b"".join(struct.pack("<7H2x", *(int(v) & 0xFFFF for v in r)) for r in rows[list(SAMPLE_FIELDS)].itertuples(index=False))
        serial = rows["serial"].iloc[0]
        if pd.isna(serial):
            kind, body = STYLUS, struct.pack("<B3x", len(rows)) + samples
        else:
            kind, body = STYLUS_SERIAL, struct.pack("<B3xI", len(rows), int(serial)) + samples
        time = REPORT.pack(TIMESTAMP, 8) + struct.pack("<2xHI", number & 0xFFFF, int(rows["timestamp"].iloc[0]) & 0xFFFFFFFF)
        frame = time + REPORT.pack(kind, len(body)) + body
        frame = FRAME.pack(number & 0xFFFF, REPORT_FRAMES[2], len(frame)) + frame
        out.append(DATA.pack(DATA_PAYLOAD, PAYLOAD.size + len(frame), 0) + PAYLOAD.pack(number, 1) + frame)
    return pd.DataFrame({"path": [str(group["capture"].iloc[0])], "content": [b"".join(out)]})


def encode_samples(samples: DataFrame) -> DataFrame:
    """Pen samples (capture, report, idx, serial, timestamp, mode, x, y, pressure, altitude, azimuth; at most 255 a report) to captures.

    Reports with a serial number are written in the form that has one. Every frame begins with a timestamp report.
    """
    ship_package(samples.sparkSession)
    return samples.select("capture", "report", "idx", "serial", *SAMPLE_FIELDS).groupBy("capture").applyInPandas(_encode_samples, "path string, content binary")
