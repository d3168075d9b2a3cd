import time

from pyspark.sql import functions as F

from tactigrid.operators import strokes
from tactigrid.sources import capture
from tactigrid.streaming import captures, live
from tests.test_grid import bump


def written(spark, folder):
    rows = [(f, 72, 48, [int(255 - 255 * min(v, 1)) for v in bump((20.0 + f, 20.0), [[3, 0], [0, 3]]).ravel()]) for f in range(4)]
    made = capture.encode_frames(spark.createDataFrame(rows, "f long, w int, h int, px array<int>"), per_capture=2).collect()
    for r in made:
        (folder / r["path"]).write_bytes(bytes(r["content"]))


def test_stream_of_files_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    written(spark, source)
    query = captures.start(captures.read_folder(spark, str(source), 1), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
    query.awaitTermination(120)
    columns = ["capture", "f", "touch_id", F.round("mean.x", 6).alias("x")]
    stream = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()}
    batch = {tuple(r) for r in captures.process_batch(capture.read_captures(spark, str(source))).select(*columns).collect()}
    assert stream == batch and len(batch) == 4


def test_device_offsets_ring_and_reset(tmp_path):
    reader = captures.DeviceReader(tmp_path)
    assert reader.read(reader.initialOffset())[1] == {"epoch": 0, "count": 0}
    for n in range(20):
        (tmp_path / f"buffer_{n % 16}").write_bytes(bytes([n]))
    (tmp_path / "doorbell").write_text("20")
    rows, end = reader.read({"epoch": 0, "count": 18})
    assert [c for _, c in rows] == [bytes([18]), bytes([19])] and end["count"] == 20
    every = list(reader.readBetweenOffsets({"epoch": 0, "count": 0}, end))
    assert [c for _, c in every] == [None] * 4 + [bytes([n]) for n in range(4, 20)]
    reader.commit(end)
    assert (tmp_path / "feedback").read_text() == "20"
    (tmp_path / "doorbell").write_text("1")
    assert reader.read(end)[1] == {"epoch": 1, "count": 1}


def test_device_stream_is_read_and_answered(spark, tmp_path):
    """18 buffers of which the ring holds 16, through readStream; then two more."""
    device, files = tmp_path / "device", tmp_path / "files"
    device.mkdir()
    files.mkdir()
    written(spark, files)
    content = sorted(files.iterdir())[0].read_bytes()
    for n in range(16):
        (device / f"buffer_{n}").write_bytes(content)
    spark.dataSource.register(captures.DeviceSource)

    def ring(doorbell):
        (device / "doorbell").write_text(str(doorbell))
        stream = spark.readStream.format("tactigrid-device").option("path", str(device)).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(str(tmp_path / "out"))

    got = ring(18)
    assert got.count() == 18 and capture.diagnostics(got).count() == 2
    assert captures.process_batch(got).select("capture").distinct().count() == 16
    assert ring(20).count() == 20 and int((device / "feedback").read_text()) >= 18


def test_stream_of_strokes_keeps_open_strokes(spark, tmp_path):
    schema = "capture string, kind string, pos long, mode int, x int, y int"
    source = tmp_path / "in"
    modes = (3, 3, 1, 3, 3, 0, 3)
    rows = [("a", "plain", i, m, i, i) for i, m in enumerate(modes)]
    for part in (rows[:1], rows[1:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = captures.stream_strokes(stream).writeStream.format("memory").queryName("stroke_rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r["pos"], r["stroke_id"], r["seq"]) for r in spark.table("stroke_rows").collect()}
    want = {(r["pos"], r["stroke_id"], r["seq"]) for r in strokes.strokes(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def _buffers(spark, folder, sizes, start=0, epoch=0):
    """Buffers of device `d` as files of a stream; only those with a size say it, the others hold a heatmap of 6 cells."""
    for n, size in enumerate(sizes, start):
        body = b""
        if size:
            body += capture.REPORT.pack(capture.DIMENSIONS, 8) + bytes((size[1], size[0], 0, size[1] - 1, 0, size[0] - 1, 0, 255))
        body += capture.REPORT.pack(capture.HEATMAP, 6) + bytes([n] * 6)
        frame = capture.FRAME.pack(0, capture.REPORT_FRAMES[0], len(body)) + body
        content = capture.DATA.pack(0, capture.PAYLOAD.size + len(frame), 0) + capture.PAYLOAD.pack(n, 1) + frame
        spark.createDataFrame([(f"d/{epoch}/{n}", content)], "path string, content binary").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)


def _assemble(spark, tmp_path, **options):
    stream = spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = live.assembled(stream, **options)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(100) and query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_dimensions_outlive_buffers_batches_and_restarts(spark, tmp_path):
    _buffers(spark, tmp_path / "in", [(3, 2), None, None, None, None])
    got = _assemble(spark, tmp_path)
    assert [tuple(r) for r in got.orderBy("number").select("number", "f", "w", "h", "note").collect()] == [(n, n, 3, 2, None) for n in range(5)]
    _buffers(spark, tmp_path / "in", [None, (2, 3), None, (5, 5), None], start=5)  # another run of the same query
    _buffers(spark, tmp_path / "in", [None], start=0, epoch=1)  # after a reset
    got = _assemble(spark, tmp_path)
    rows = [tuple(r) for r in got.where("number > 4 or epoch = 1").orderBy("epoch", "number").select("epoch", "number", "f", "w", "h").collect()]
    assert rows == [(0, 5, 5, 3, 2), (0, 6, 6, 2, 3), (0, 7, 7, 2, 3), (0, 8, None, 5, 5), (0, 9, None, 5, 5), (1, 0, None, 5, 5)]
    assert {r["note"] for r in live.notes(got).collect()} == {"6 cells, 5 x 5 expected"}
    dense = live.frames(got).where("f = 5").first()
    assert dense["px"] == [1 - 5 / 255] * 6 and dense["capture"] == "d/0/5"


def test_heatmaps_before_dimensions_late_buffers_and_epochs_of_their_own(spark, tmp_path):
    _buffers(spark, tmp_path / "in", [None, (3, 2), None])
    _buffers(spark, tmp_path / "in", [None], start=0, epoch=1)
    got = _assemble(spark, tmp_path, across_resets=False)
    assert {(r["epoch"], r["number"], r["note"]) for r in live.notes(got).collect()} == {(0, 0, "no dimensions yet"), (1, 0, "no dimensions yet")}
    _buffers(spark, tmp_path / "in", [None], start=1)
    got = _assemble(spark, tmp_path, across_resets=False)
    assert got.where("note like 'late%'").count() == 1 and got.where("note is null").count() == 2


def test_silent_devices_are_forgotten(spark, tmp_path):
    """Timers make batches of their own, so this query never ends by itself."""
    _buffers(spark, tmp_path / "in", [(3, 2)])
    stream = spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = live.assembled(stream, idle_seconds=2)
    query = found.writeStream.format("memory").queryName("forgotten").trigger(processingTime="200 milliseconds").start()

    def wait(condition):
        until = time.time() + 60
        while spark.table("forgotten").where(condition).isEmpty():
            assert query.isActive and time.time() < until
            time.sleep(0.3)

    wait("note = 'forgotten after 1 frames'")
    _buffers(spark, tmp_path / "in", [None], start=1)
    wait("number = 1 and note = 'no dimensions yet'")
    query.stop()


def test_a_table_of_buffers_gives_what_a_stream_does(spark, tmp_path):
    _buffers(spark, tmp_path / "in", [(3, 2), None, None])
    table = spark.read.parquet(str(tmp_path / "in"))
    assert live.frames(live.assembled(table)).count() == 3


def test_live_contacts(spark, tmp_path):
    """Four frames of one contact, dimensions in the first buffer only."""
    for f in range(4):
        cells = bytes(int(255 - 255 * min(v, 1)) for v in bump((20.0 + f, 20.0), [[3, 0], [0, 3]]).ravel())
        body = (capture.REPORT.pack(capture.DIMENSIONS, 8) + bytes((48, 72, 0, 47, 0, 71, 0, 255)) if f == 0 else b"") + capture.REPORT.pack(capture.HEATMAP, len(cells)) + cells
        frame = capture.FRAME.pack(0, capture.REPORT_FRAMES[0], len(body)) + body
        content = capture.DATA.pack(0, capture.PAYLOAD.size + len(frame), 0) + capture.PAYLOAD.pack(f, 1) + frame
        spark.createDataFrame([(f"d/0/{f}", content)], "path string, content binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.start(stream, str(tmp_path / "out"), str(tmp_path / "state"), idle_seconds=None, availableNow=True).awaitTermination(100)
    got = {(r["capture"], round(r["mean"]["x"], 3)) for r in spark.read.parquet(str(tmp_path / "out" / "touches")).collect()}
    assert len(got) == 4 and spark.read.parquet(str(tmp_path / "out" / "notes")).isEmpty()
