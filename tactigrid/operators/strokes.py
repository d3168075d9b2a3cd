"""Pen samples to strokes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions.matrices import pen_down
from tactigrid.session import checkpointed


def strokes(samples: DataFrame) -> DataFrame:
    """samples: capture, kind, pos, mode, x, y, pressure. Runs of pen contact in stream order: adds stroke_id (from 1) and seq (from 0)."""
    stream = Window.partitionBy("capture", "kind").orderBy("pos")
    d = samples.withColumn("down_", pen_down(F.col("mode")))
    ended = F.coalesce(F.lag("down_").over(stream), F.lit(False)) & ~F.col("down_")
    d = d.withColumn("ended_", F.when(ended, 1).otherwise(0)).withColumn("run_", F.sum("ended_").over(stream)).where("down_")
    d = d.withColumn("stroke_id", F.dense_rank().over(Window.partitionBy("capture", "kind").orderBy("run_")))
    return d.withColumn("seq", F.row_number().over(Window.partitionBy("capture", "kind", "run_").orderBy("pos")) - 1).drop("down_", "ended_", "run_")


def strokes_in_ranges(samples: DataFrame) -> DataFrame:
    """The same of streams of any length: rows are dealt by range of (capture, kind, pos), so a stream lies in as many tasks as it needs.

    Strokes and places are counted within each range, and ranges are summed up in a row each for every stream: whether they begin and end
    in contact, how many strokes begin in them, and how long the run of contact at their end is. Windows over these rows tell a range
    where it begins: how many strokes began before, and how many samples of an open stroke.
    """
    stream = ["capture", "kind"]
    dealt = checkpointed(samples.withColumn("down_", pen_down(F.col("mode"))).repartitionByRange(*stream, "pos").withColumn("range_", F.spark_partition_id()))
    within = Window.partitionBy("range_", *stream).orderBy("pos")
    before = F.lag("down_").over(within)
    marked = dealt.withColumn("first_", F.row_number().over(within) == 1).withColumn("start_", F.col("down_") & ~F.coalesce(before, F.lit(False)))
    lifted = F.max(F.when(~F.col("down_"), F.col("pos"))).over(Window.partitionBy("range_", *stream))
    ranges = marked.withColumn("lifted_", lifted).groupBy(*stream, "range_").agg(
        F.min_by("down_", "pos").alias("begins"), F.max_by("down_", "pos").alias("ends"), F.count_if("start_").alias("starts"),
        F.every("down_").alias("whole"), F.count_if(F.col("down_") & (F.col("lifted_").isNull() | (F.col("pos") > F.col("lifted_")))).alias("tail"),
    )
    order = Window.partitionBy(*stream).orderBy("range_")  # a row a range
    held = F.coalesce(F.lag("ends").over(order), F.lit(False)) & F.col("begins")  # its first run belongs to an earlier stroke
    ranges = ranges.withColumn("held", held).withColumn("group", F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(order))
    ranges = ranges.withColumn("open", F.sum("tail").over(Window.partitionBy(*stream, "group").orderBy("range_")))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.coalesce(F.sum(F.col("starts") - F.col("held").cast("int")).over(earlier), F.lit(0))
    ranges = ranges.select(*stream, "range_", "held", counted.alias("base_"), F.when(F.col("held"), F.lag("open").over(order)).otherwise(0).alias("open_"))
    d = marked.join(ranges, [*stream, "range_"])
    d = d.withColumn("local_", F.sum((F.col("start_") & ~(F.col("first_") & F.col("held"))).cast("int")).over(within)).where("down_")
    place = F.row_number().over(Window.partitionBy("range_", *stream, "local_").orderBy("pos")) - 1
    d = d.withColumn("stroke_id", (F.col("base_") + F.col("local_")).cast("int"))
    return d.withColumn("seq", (place + F.when(F.col("local_") == 0, F.col("open_")).otherwise(0)).cast("int")).select(*samples.columns, "stroke_id", "seq")


def polylines(found: DataFrame) -> DataFrame:
    """One row per stroke: points as an array of (x, -y) in order."""
    points = F.array_sort(F.collect_list(F.struct("seq", F.col("x").alias("px"), (-F.col("y")).alias("py"))))
    return found.groupBy("capture", "kind", "stroke_id").agg(F.count("*").alias("n"), F.transform(points, lambda p: F.struct(p["px"].alias("x"), p["py"].alias("y"))).alias("points"))
