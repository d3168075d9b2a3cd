"""python -m tactigrid process INPUT OUTPUT | plot INPUT OUTPUT [SCALE] | strokes INPUT OUTPUT | perf INPUT [PASSES]"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tactigrid.operators import fit, metrics, strokes
from tactigrid.sources import capture, frames, images
from tactigrid.streaming.captures import process_batch


def _frames(captures: DataFrame) -> DataFrame:
    return capture.heatmaps(capture.reports(captures)).select("capture", "f", "w", "h", "px")


def process(spark: SparkSession, source: str, target: str) -> None:
    """Contacts of all captures, as Parquet."""
    process_batch(capture.read_captures(spark, source)).write.mode("overwrite").parquet(target)


def plot(spark: SparkSession, source: str, target: str, scale: str = "12") -> None:
    """Every frame with its contacts, as PNG; frames of several captures are numbered on, capture after capture."""
    found = _frames(capture.read_captures(spark, source))
    counts = found.groupBy("capture").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("capture").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a capture
    numbered = found.join(counts.select("capture", before.alias("before")), "capture").withColumn("f", F.col("f") + F.col("before"))
    cells = images.coloured(frames.to_long(numbered))
    spark.dataSource.register(images.PngSink)
    images.plots(cells, fit.touch_points(numbered)).write.format("tactigrid-png").option("scale", scale).mode("overwrite").save(target)


def strokes_of(spark: SparkSession, source: str, target: str) -> None:
    """Polylines of all pen strokes, as Parquet."""
    samples = capture.stylus(capture.reports(capture.read_captures(spark, source))).withColumn("pos", F.col("pos") * 256 + F.col("idx"))
    strokes.polylines(strokes.strokes(samples)).write.mode("overwrite").parquet(target)


def perf(spark: SparkSession, source: str, passes: str = "50") -> None:
    """Times of the stages of the contact pipeline over all frames, measured within each of so many runs."""
    found = _frames(capture.read_captures(spark, source)).persist()
    rows = []
    for _ in range(int(passes)):
        seen = Observation()
        metrics.observed_stages(fit.touch_points(found, timed=True), seen).write.format("noop").mode("overwrite").save()
        contacts, stages = metrics.stages_of(seen.get)
        rows += [(s["stage"], k, s["n"], s["total_us"], s["min_us"], s["max_us"]) for k, s in enumerate(stages)]
    found.unpersist()
    print(f"contacts: {contacts}")
    table = spark.createDataFrame(rows, "stage string, place int, n long, total_us double, min_us double, max_us double")
    table.groupBy("stage", "place").agg(F.sum("n").alias("n"), F.sum("total_us").alias("total_us"), (F.sum("total_us") / F.sum("n")).alias("mean_us"), F.stddev_samp(F.col("total_us") / F.col("n")).alias("stddev_us"), F.min("min_us").alias("min_us"), F.max("max_us").alias("max_us")).orderBy("place").drop("place").show(truncate=False)


#: Name: what runs, the least and the most arguments.
COMMANDS: dict[str, tuple[Callable, int, int]] = {"process": (process, 2, 2), "plot": (plot, 2, 3), "strokes": (strokes_of, 2, 2), "perf": (perf, 1, 2)}


def main(arguments: list[str]) -> int:
    run, least, most = COMMANDS.get(arguments[0] if arguments else "", (None, 0, 0))
    if run is None or not least <= len(arguments) - 1 <= most:
        print(__doc__)
        return 2
    run(SparkSession.builder.appName("tactigrid").getOrCreate(), *arguments[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
