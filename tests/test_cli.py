"""The command line, and the stages' times of one run."""

import pytest
from pyspark.sql import Observation

from tactigrid import __main__ as cli
from tactigrid.operators import dense, fit, metrics
from tactigrid.sources import capture
from tests.test_grid import bump


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f, 72, 48, [int(255 - 255 * min(v, 1)) for v in bump((20.0 + f, 20.0), [[3, 0], [0, 3]]).ravel()]) for f in range(4)]
    source = tmp_path / "captures"
    source.mkdir()
    for r in capture.encode_frames(spark.createDataFrame(rows, "f long, w int, h int, px array<int>"), per_capture=2).collect():
        (source / r["path"]).write_bytes(bytes(r["content"]))
    return source


def test_stages_are_timed_in_the_run_that_finds_the_contacts(spark, folder):
    found = capture.heatmaps(capture.reports(capture.read_captures(spark, str(folder))))
    seen = Observation()
    contacts = metrics.observed_stages(fit.touch_points(found, timed=True), seen)
    assert contacts.columns == fit.touch_points(found).columns
    assert sorted(map(tuple, contacts.collect())) == sorted(map(tuple, fit.touch_points(found).collect()))
    n, stages = metrics.stages_of(seen.get)
    assert n == 4 and [s["stage"] for s in stages] == list(dense.STAGES) and all(s["n"] == 4 for s in stages)
    total = stages[-1]["total_us"]
    assert 0 < total and abs(sum(s["total_us"] for s in stages[:-1]) - total) < 0.2 * total
    assert all(s["min_us"] <= s["mean_us"] <= s["max_us"] for s in stages)


def test_no_frames_no_times(spark):
    seen = Observation()
    nothing = spark.createDataFrame([], "f long, w int, h int, px array<double>")
    assert metrics.observed_stages(fit.touch_points(nothing, timed=True), seen).count() == 0
    assert metrics.stages_of(seen.get)[0] == 0


def test_commands(spark, folder, tmp_path, capsys):
    assert cli.main(["process", str(folder), str(tmp_path / "touches")]) == 0
    assert spark.read.parquet(str(tmp_path / "touches")).count() == 4
    assert cli.main(["plot", str(folder), str(tmp_path / "plots"), "4"]) == 0
    assert sorted(p.name for p in (tmp_path / "plots").iterdir()) == [f"out-000{k}.png" for k in range(1, 5)]
    image = spark.read.format("image").load(str(tmp_path / "plots")).select("image.width", "image.height").distinct().collect()
    assert image == [(288, 192)]
    assert cli.main(["perf", str(folder), "2"]) == 0
    shown = capsys.readouterr().out
    assert "contacts: 4" in shown and all(stage in shown for stage in dense.STAGES) and "|8 " in shown


def test_strokes_command(spark, tmp_path):
    rows = [("pen", k // 2, k % 2, None, k, 3 if k != 2 else 0, k, k, 0, 0, 0) for k in range(6)]
    made = capture.encode_samples(spark.createDataFrame(rows, "capture string, report long, idx int, serial long, timestamp long, mode int, x int, y int, pressure int, altitude int, azimuth int")).first()
    (tmp_path / "pens").mkdir()
    (tmp_path / "pens" / "pen").write_bytes(bytes(made["content"]))
    assert cli.main(["strokes", str(tmp_path / "pens"), str(tmp_path / "strokes")]) == 0
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "strokes")).collect()) == [2, 3]


def test_wrong_commands_tell_the_usage(capsys):
    for arguments in ([], ["nothing"], ["process", "a"], ["perf"], ["strokes", "a", "b", "c"]):
        assert cli.main(arguments) == 2
    assert "python -m tactigrid" in capsys.readouterr().out
