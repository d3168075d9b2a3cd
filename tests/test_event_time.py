"""Clocks that wrap, windows across batches and restarts, late reports; functions and table functions in SQL."""

import random
import struct

import pytest

from tactigrid.functions import matrices, registration
from tactigrid.sources import capture
from tactigrid.streaming import event_time

WIDTH, LATENESS = 100, 250


def buffer(*ticks):
    body = b"".join(capture.REPORT.pack(capture.TIMESTAMP, 8) + struct.pack("<2xHI", 0, t % 2**32) for t in ticks)
    frame = capture.FRAME.pack(0, capture.REPORT_FRAMES[0], len(body)) + body
    return capture.DATA.pack(0, capture.PAYLOAD.size + len(frame), 0) + capture.PAYLOAD.pack(0, 1) + frame


def direct(ticks):
    """Closed windows and late ticks, one report after the other."""
    newest, counts, closed, late = ticks[0], {}, {}, []
    for t in ticks:
        start = t // WIDTH * WIDTH
        if start + WIDTH <= newest - LATENESS:
            late.append(t)
            continue
        counts[start] = counts.get(start, 0) + 1
        newest = max(newest, t)
        for k in [k for k in counts if k + WIDTH <= newest - LATENESS]:
            closed[k] = counts.pop(k)
    return closed, sorted(late), sum(counts.values())


def given(spark, buffers):
    return spark.createDataFrame(buffers, "path string, content binary")


def found(rows, device="d"):
    own = [r for r in rows if r["device"] == device]
    return {r["start"]: r["n"] for r in own if r["kind"] == "window"}, sorted(r["ticks"] for r in own if r["kind"] == "late")


def test_every_report_is_in_a_window_or_late_across_batches_and_restarts(spark, tmp_path):
    rng = random.Random(3)
    ticks = [max(0, 40 * k + 2**32 - 3000 + rng.choice([0, 0, 5, -90, -700])) for k in range(300)]  # wraps on the way
    buffers = [(f"d/0/{n}", buffer(*ticks[10 * n : 10 * n + 10])) for n in range(30)] + [(f"slow/0/{n}", buffer(n, n + 1)) for n in range(3)]
    closed, late, open_ = direct(ticks)
    assert late and open_ and sum(closed.values()) + len(late) + open_ == 300
    batch = event_time.windows(given(spark, buffers), WIDTH, LATENESS).collect()
    assert found(batch) == (closed, late) and found(batch, "slow") == ({}, [])
    for part in (buffers[:7] + buffers[30:], buffers[7:20], buffers[20:30]):  # a run of the query each
        given(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("path string, content binary").parquet(str(tmp_path / "in"))
        assert event_time.start(stream, str(tmp_path / "out"), str(tmp_path / "state"), WIDTH, LATENESS, availableNow=True).awaitTermination(100)
    counts = spark.read.parquet(str(tmp_path / "out" / "windows")).collect()
    assert len(counts) == len(closed) and {r["start"]: r["n"] for r in counts} == closed
    assert sorted(r["ticks"] for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()) == late


def test_a_reset_goes_on_from_the_newest_tick(spark):
    rows = event_time.windows(given(spark, [("d/0/0", buffer(5, 105, 905)), ("d/1/0", buffer(0, 400))]), WIDTH, LATENESS).collect()
    assert found(rows) == ({0: 1, 100: 1, 900: 2}, [])


@pytest.fixture
def functions(spark):
    return registration.register(spark)


def test_functions_in_sql_are_the_column_functions(spark, functions):
    rows = spark.createDataFrame([(3.0, 1.0, 2.0), (0.0, 0.0, 0.0), (-1.0, 0.5, 4.0)], "xx double, xy double, yy double")
    e1, e2 = matrices.eigenvalues(*(matrices.F.col(c) for c in rows.columns))
    want = rows.select(e1, e2, matrices.ridge(e1, e2), matrices.coherence(e1, e2), matrices.inverse(*(matrices.F.col(c) for c in rows.columns)))
    got = spark.sql("SELECT grid_eigenvalue_1(xx, xy, yy) e1, grid_eigenvalue_2(xx, xy, yy) e2, grid_ridge(e1, e2), grid_coherence(e1, e2), grid_inverse(xx, xy, yy) FROM {rows}", rows=rows)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(functions) == 14


def test_table_functions_decode_captures(spark, functions):
    whole = buffer(1, 2)
    made = given(spark, [("a", whole), ("b", whole[:-3]), ("c", None)])
    query = "SELECT path, {0} FROM {{made}}, LATERAL {1}(path, content)"
    got = spark.sql(query.format("pos, report_type, payload", "decode_capture"), made=made).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in capture.reports(made).select("capture", "pos", "report_type", "payload").collect())
    notes = spark.sql(query.format("pos, level, message", "capture_notes"), made=made).collect()
    assert sorted(map(tuple, notes)) == sorted(tuple(r) for r in capture.diagnostics(made, "DBG").select("capture", "pos", "level", "message").collect())


def test_reports_of_a_table_that_come_in_many_batches_are_in_order(spark):
    """A device's 900 reports, more than an Arrow batch holds, in buffers whose rows are in no order."""
    ticks = [40 * k - (700 if k % 25 == 24 else 0) + 1000 for k in range(900)]
    buffers = [(f"d/0/{n}", buffer(*ticks[10 * n : 10 * n + 10])) for n in range(90)]
    random.Random(4).shuffle(buffers)
    closed, late, open_ = direct(ticks)
    assert late and found(event_time.windows(given(spark, buffers), WIDTH, LATENESS).collect()) == (closed, late)
