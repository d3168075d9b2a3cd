"""Frames as PNG files, one each, with what is drawn over them.

`plots` makes a row of each frame: its cells' colours and the segments and captions of its contacts, gathered by frame.
`PngSink` renders rows where they are and writes files through the staged folder of `splits.FileSink`.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.functions import colour
from tactigrid.operators import metrics
from tactigrid.sources import frames
from tactigrid.sources.splits import FileSink, FileWriter

#: Colours of what is drawn, by kind.
COLOURS = {"cross_x": (255, 0, 0), "cross_y": (255, 0, 0), "ellipse": (255, 0, 0), "axis_1": (0, 0, 0), "axis_2": (0, 0, 0)}
#: Letters of three by five dots: five rows of three bits, each as an octal digit.
GLYPHS = {"0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717", ".": "00002", "-": "00700", ":": "02020", "a": "07357", "c": "07447", "s": "03426"}

SEGMENTS, CAPTIONS = "array<struct<kind:string,x1:double,y1:double,x2:double,y2:double>>", "array<struct<x:double,y:double,text:string>>"


def _stroke(image: np.ndarray, segment: dict, scale: int) -> None:
    """A line between two places of the frame; a cell's middle is half a cell from its corner."""
    ends = np.array([[segment["x1"], segment["y1"]], [segment["x2"], segment["y2"]]], float)
    if not np.isfinite(ends).all() or np.abs(ends).max() > 1e6:
        return
    ends = (ends + 0.5) * scale
    n = int(np.abs(ends[1] - ends[0]).max()) + 2
    x, y = np.floor(np.linspace(ends[0], ends[1], n)).astype(int).T
    inside = (x >= 0) & (x < image.shape[1]) & (y >= 0) & (y < image.shape[0])
    image[y[inside], x[inside]] = COLOURS.get(segment["kind"], (255, 255, 255))


def _write(image: np.ndarray, caption: dict, scale: int) -> None:
    if not np.isfinite([caption["x"], caption["y"]]).all():
        return
    left, top = int((caption["x"] + 0.5) * scale), int((caption["y"] + 0.5) * scale)
    for k, letter in enumerate(caption["text"]):
        for row, bits in enumerate(GLYPHS.get(letter, "00000")):
            for column in range(3):
                x, y = left + 4 * k + column, top + row
                if int(bits, 8) >> (2 - column) & 1 and 0 <= x < image.shape[1] and 0 <= y < image.shape[0]:
                    image[y, x] = 255


def rendered(row: dict, scale: int) -> np.ndarray:
    """(rows, columns, 3) bytes of a row of `plots`."""
    cells = np.stack([np.asarray(row[c], np.uint8).reshape(row["h"], row["w"]) for c in ("r", "g", "b")], -1)
    image = cells.repeat(scale, 0).repeat(scale, 1)
    for segment in row["segments"] or ():
        _stroke(image, segment, scale)
    for caption in row["captions"] or ():
        _write(image, caption, scale)
    return image


def png(image: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, _ = image.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


class PngSink(FileSink):
    """format("tactigrid-png"): rows of `plots` as out-0001.png and so on, by their number; option `scale`: dots of a cell's side."""

    @classmethod
    def name(cls) -> str:
        return "tactigrid-png"

    def schema(self) -> str:
        return f"number long, w int, h int, r array<int>, g array<int>, b array<int>, segments {SEGMENTS}, captions {CAPTIONS}"

    def writer(self, schema, overwrite: bool):  # noqa: ANN001, ANN201
        return PngWriter(self.options["path"], overwrite, int(self.options.get("scale", "1")))


class PngWriter(FileWriter):
    def __init__(self, folder: str, overwrite: bool, scale: int) -> None:
        super().__init__(folder, overwrite)
        self.scale = scale

    def encoded(self, row) -> tuple[str, bytes]:  # noqa: ANN001
        return f"out-{row['number']:04d}.png", png(rendered(row.asDict(recursive=True), self.scale))


def coloured(pixels: DataFrame, map_=colour.cubehelix, column: str = "v") -> DataFrame:
    """f, x, y, w, h and r, g, b (0 to 255) of pixels with values of 0 to 1."""
    parts = map_(F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(1.0)))
    return pixels.select("f", "x", "y", "w", "h", *(F.floor(p * 255 + 0.5).cast("int").alias(c) for c, p in zip("rgb", parts, strict=True)))


def plots(cells: DataFrame, contacts: DataFrame | None = None, sigmas: float = 1.0) -> DataFrame:
    """Rows for PngSink: cells (f, x, y, w, h, r, g, b) by frame, with axes, crosses, ellipses and captions of contacts (f, touch_id, confidence, scale, mean, cov). number: of the frame, f + 1."""
    rows = frames.to_dense_columns(cells, ["r", "g", "b"])
    if contacts is None:
        drawn = rows.withColumns({"segments": F.lit(None), "captions": F.lit(None)})
    else:
        found = metrics.ellipses(contacts, sigmas=sigmas)
        lines = metrics.overlay(found, 0.4).unionByName(metrics.outlines(found))
        segments = lines.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("kind", "x1", "y1", "x2", "y2"))).alias("segments"))
        captions = metrics.captions(found).groupBy("f").agg(F.sort_array(F.collect_list(F.struct("x", "y", "text"))).alias("captions"))
        drawn = rows.join(segments, "f", "left").join(captions, "f", "left")
    return drawn.select((F.col("f") + 1).alias("number"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "r", "g", "b", F.col("segments").cast(SEGMENTS).alias("segments"), F.col("captions").cast(CAPTIONS).alias("captions"))
