"""The life cycle of devices, alone and through a stream; splits, images and functions in SQL."""

import json
import time

import pytest

from tactigrid.sources import capture
from tactigrid.streaming import devices, live
from tactigrid.streaming.devices import RING, Buffers, DevicesReader


def ring(folder, low, high):
    """Buffers low to high of a device, each a heatmap of 6 cells; buffer 0 says the dimensions."""
    folder.mkdir(parents=True, exist_ok=True)
    for n in range(low, high):
        (folder / f"buffer_{n % RING}").write_bytes(capture._record(n, 3, 2, bytes([n % 256] * 6), n == 0))
    (folder / "doorbell").write_text(str(high))


def reader(path, **options):
    return DevicesReader({"path": str(path), "ready_pause": "0.01", **options})


def contents(r, start, end):
    return [(p, c is not None) for part in r.partitions(start, end) for p, c in r.read(part)]


def test_offsets_partitions_and_feedback(tmp_path):
    ring(tmp_path / "a", 0, 3)
    ring(tmp_path / "b", 0, 20)
    r = reader(tmp_path, buffers_per_task="6")
    start, end = r.initialOffset(), r.latestOffset()
    assert start == {} and end == {"a": [0, 3], "b": [0, 20]}
    assert [(p.device, p.low, p.high) for p in r.partitions(start, end)] == [("a", 0, 3), ("b", 0, 6), ("b", 6, 12), ("b", 12, 18), ("b", 18, 20)]
    assert contents(r, start, end) == [(f"a/0/{n}", True) for n in range(3)] + [(f"b/0/{n}", n >= 4) for n in range(20)]
    assert not (tmp_path / "a" / "feedback").exists()
    r.commit(end)
    assert (tmp_path / "b" / "feedback").read_text() == "20"
    assert r.partitions(end, r.latestOffset()) == []


def test_a_reset_flushes_and_begins_a_new_epoch(tmp_path):
    ring(tmp_path / "a", 0, 9)
    r = reader(tmp_path)
    first = r.latestOffset()
    ring(tmp_path / "a", 0, 2)
    second = r.latestOffset()
    assert second == {"a": [1, 2]} and (tmp_path / "a" / "flushed").read_text() == str(RING)
    assert contents(r, first, second) == [("a/1/0", True), ("a/1/1", True)]
    assert contents(r, {}, first) == [(f"a/0/{n}", False) for n in range(9)]  # replayed after the reset: lost, and told


def test_devices_that_are_not_ready_have_no_news(tmp_path):
    ring(tmp_path / "a", 0, 2)
    ring(tmp_path / "b", 0, 2)
    (tmp_path / "a" / "ready").write_text("0")
    r = reader(tmp_path, ready_attempts="3")
    began = time.monotonic()
    assert r.latestOffset() == {"b": [0, 2]} and time.monotonic() - began >= 0.02
    (tmp_path / "a" / "ready").write_text("1")
    assert r.latestOffset() == {"a": [0, 2], "b": [0, 2]}


def test_start_at_latest_flushes(tmp_path):
    ring(tmp_path / "a", 0, 5)
    r = reader(tmp_path, startingOffsets="latest")
    assert r.initialOffset() == {"a": [0, 5]} and (tmp_path / "a" / "flushed").exists()
    ring(tmp_path / "a", 5, 7)
    assert contents(r, {"a": [0, 5]}, r.latestOffset()) == [("a/0/5", True), ("a/0/6", True)]


def test_a_buffer_that_is_written_over_is_missed(tmp_path):
    ring(tmp_path / "a", 0, 4)
    r = reader(tmp_path)
    planned = r.partitions({}, r.latestOffset())
    ring(tmp_path / "a", 4, 4 + RING - 2)  # places 0 and 1 hold buffers 16 and 17 now
    assert [(p, c is not None) for part in planned for p, c in r.read(part)] == [("a/0/0", False), ("a/0/1", False), ("a/0/2", True), ("a/0/3", True)]
    assert list(r.read(Buffers("gone", 0, 0, 1, True))) == [("gone/0/0", None)]


def test_buffers_are_cut_to_the_size_that_the_device_tells(tmp_path):
    ring(tmp_path / "a", 0, 1)
    (tmp_path / "a" / "info").write_text(json.dumps({"vendor": 1, "product": 2, "buffer_size": 70}))
    r = reader(tmp_path)
    assert [len(c) for part in r.partitions({}, r.latestOffset()) for _, c in r.read(part)] == [70]


def test_stream_of_devices_across_a_restart(spark, tmp_path):
    """Dimensions in the first buffer only; the second run of the query goes on where the first ended."""
    source, out, state = tmp_path / "devices", tmp_path / "out", tmp_path / "state"
    spark.dataSource.register(devices.DevicesSource)
    spark.dataSource.register(devices.InfoSource)

    def run():
        stream = spark.readStream.format("tactigrid-devices").option("path", str(source)).option("buffers_per_task", 4).load()
        query = live.assembled(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).start()
        query.processAllAvailable()
        query.stop()
        return {(r["device"], r["number"], r["f"]) for r in spark.read.parquet(str(out)).where("note is null").collect()}

    ring(source / "a", 0, 6)
    ring(source / "b", 0, 2)
    assert run() == {("a", n, n) for n in range(6)} | {("b", 0, 0), ("b", 1, 1)}
    ring(source / "a", 6, 11)
    assert run() == {("a", n, n) for n in range(11)} | {("b", 0, 0), ("b", 1, 1)}
    (source / "b" / "info").write_text(json.dumps({"vendor": 7, "product": 8, "version": 1, "buffer_size": 4096}))
    info = {r["device"]: (r["vendor"], r["buffer_size"], r["doorbell"]) for r in spark.read.format("tactigrid-device-info").load(str(source)).collect()}
    assert info == {"a": (None, None, 11), "b": (7, 4096, 2)}


@pytest.fixture
def long_capture(tmp_path):
    folder = tmp_path / "captures"
    folder.mkdir()
    whole = b"".join(capture._record(n, 3, 2, bytes([n % 256] * 6), n == 0) for n in range(500))
    (folder / "long.bin").write_bytes(whole)
    (folder / "cut.bin").write_bytes(whole[:-5])
    (folder / "short.bin").write_bytes(whole[:30])
    (folder / "empty.bin").write_bytes(b"")
    return folder


def test_one_large_file_is_read_by_many_tasks(spark, long_capture):
    from pyspark.sql import functions as F

    from tactigrid.sources import splits

    ranges = splits.record_splits(spark, str(long_capture), 4096)
    parts = splits.read_splits(ranges, 8)
    assert parts.where("path like '%long.bin'").select(F.spark_partition_id()).distinct().count() >= 4 and ranges.count() > 20
    whole = capture.read_captures(spark, str(long_capture))
    assert sorted(capture.reports(parts).collect()) == sorted(capture.reports(whole).collect())
    assert sorted(map(tuple, capture.diagnostics(parts, "DBG").collect()), key=repr) == sorted(map(tuple, capture.diagnostics(whole, "DBG").collect()), key=repr)
    assert capture.heatmaps(capture.reports(parts)).where("capture like '%long.bin'").count() == 500


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_heatmaps_of_one_capture_in_several_ranges(spark, ranges):
    sizes = {0: (3, 2), 40: (2, 3), 41: (6, 1), 90: (5, 5), 120: (1, 6)}  # of frames 90 to 119 none has the cells that are said
    whole = b"".join(capture._record(n, *sizes.get(n, (1, 1)), bytes([n % 256] * 6), n in sizes) for n in range(200))
    late = b"".join(capture._record(n, 3, 2, bytes([n] * 6), n == 30) for n in range(50))  # dimensions come late
    found = capture.reports(spark.createDataFrame([("a", whole), ("b", late)], "path string, content binary"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = sorted(map(tuple, capture.heatmaps_in_ranges(found).collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == sorted(map(tuple, capture.heatmaps(found).collect())) and len(got) == 170 + 20


def test_files_are_there_together_or_not_at_all(spark, tmp_path):
    from tactigrid.sources import splits

    spark.dataSource.register(splits.FileSink)
    rows = spark.createDataFrame([(f"{n % 2}/{n}.bin", bytes([n])) for n in range(6)], "path string, content binary")
    target = tmp_path / "files"
    rows.write.format("tactigrid-files").mode("append").save(str(target))
    assert {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*.bin")} == {f"{n % 2}/{n}.bin": bytes([n]) for n in range(6)}
    rows.limit(1).write.format("tactigrid-files").mode("append").save(str(target))
    bad = rows.unionByName(spark.createDataFrame([("../outside.bin", b"x")], "path string, content binary"))
    for folder in (target, tmp_path / "none"):
        with pytest.raises(Exception, match="outside"):
            bad.write.format("tactigrid-files").mode("append").save(str(folder))
    assert len(list(target.rglob("*.bin"))) == 6 and sorted(p.name for p in tmp_path.iterdir()) == ["files"]
    rows.limit(2).write.format("tactigrid-files").mode("overwrite").save(str(target))
    assert len(list(target.rglob("*.bin"))) == 2


def test_images_decode_to_what_was_drawn(spark, tmp_path):
    import numpy as np

    from tactigrid.sources import images

    cells = spark.createDataFrame([(0, x, y, 12, 8, 10 * x, 20 * y, 7) for x in range(12) for y in range(8)], "f long, x int, y int, w int, h int, r int, g int, b int")
    contact = spark.createDataFrame([(0, 1, 0.93, 0.5, (6.0, 3.0), (1.0, 0.0, 1.0))], "f long, touch_id int, confidence double, scale double, mean struct<x:double,y:double>, cov struct<xx:double,xy:double,yy:double>")
    spark.dataSource.register(images.PngSink)
    images.plots(cells).write.format("tactigrid-png").mode("append").save(str(tmp_path / "plain"))
    images.plots(cells, contact).write.format("tactigrid-png").option("scale", 12).mode("append").save(str(tmp_path / "drawn"))

    def read(folder):
        row = spark.read.format("image").load(str(tmp_path / folder / "out-0001.png")).first()["image"]
        return np.frombuffer(bytes(row["data"]), np.uint8).reshape(row["height"], row["width"], 3)[:, :, ::-1]

    plain, drawn = read("plain"), read("drawn")
    assert plain.tolist() == [[[10 * x, 20 * y, 7] for x in range(12)] for y in range(8)]
    assert drawn.shape == (96, 144, 3) and drawn[0, 143].tolist() == [110, 0, 7]
    assert drawn[42, 78].tolist() == [255, 0, 0] and drawn[42, 90].tolist() == [255, 0, 0]  # the cross at the mean, the ellipse a deviation off it
    lit = (drawn == 255).all(-1)  # captions: c, a and s, each of six letters, three rows of them beside the mean
    assert [int(lit[int((3 + dy + 0.5) * 12) :][:5, 36 : 36 + 24].sum()) for dy in (3, 2, 1)] == [sum(sum(int(d, 8).bit_count() for d in images.GLYPHS[k]) for k in text) for text in ("c:0.93", "a:1.00", "s:0.50")]
