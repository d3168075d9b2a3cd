"""Connected components: labels, statistics, scores and classes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions.matrices import logistic
from tactigrid.operators import dense
from tactigrid.operators.batches import map_pixels
from tactigrid.session import checkpointed, ship_package


def label_frames(frames: DataFrame, threshold: float = 0.0, connectivity: int = 4, inclusive: bool = False, down: int = 1, column: str = "px", carry: Sequence[str] = ("px",)) -> DataFrame:
    """Dense frames (f, w, h, arrays) to (f, w, h, carried arrays, label): one array of labels a frame, of one of its arrays, without an exchange.

    inclusive: pixels at the threshold are foreground. down = 2 steps over the next row (see `dense.labels`).
    """
    ship_package(frames.sparkSession)
    run = map_pixels(lambda v: dense.labels(v >= threshold if inclusive else v > threshold, connectivity, down), [column], "label", pa.int32(), tuple(carry))
    kinds = "".join(f"{c} {frames.schema[c].dataType.simpleString()}, " for c in carry)
    return frames.select("f", "w", "h", *dict.fromkeys([column, *carry])).mapInArrow(run, f"f long, w int, h int, {kinds}label array<int>")


def label_pixels(frames: DataFrame, threshold: float = 0.0, connectivity: int = 4, inclusive: bool = False, down: int = 1) -> DataFrame:
    """Long form: f, x, y, label."""
    found = label_frames(frames, threshold, connectivity, inclusive, down)
    return found.select("f", "w", F.posexplode("label").alias("i", "label")).select("f", (F.col("i") % F.col("w")).cast("int").alias("x"), F.expr("cast(i div w as int)").alias("y"), "label")


def label_relational(pixels: DataFrame, threshold: float = 0.0, connectivity: int = 4, rounds: int = 10_000) -> DataFrame:
    """The same from long pixels by joins: runs along x, overlaps of neighbouring rows, least run propagated to all.

    For frames too large for one task; a round is one job, written to the checkpoint folder.
    """
    row = Window.partitionBy("f", "y").orderBy("x")
    runs = pixels.where(F.col("v") > threshold).withColumn("g", F.col("x") - F.row_number().over(row))
    runs = runs.groupBy("f", "y", "w", "g").agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    runs = checkpointed(runs.select("f", "y", "x1", "x2", (F.col("y") * F.col("w") + F.col("x1")).cast("long").alias("id")))
    a, b = runs.alias("a"), runs.alias("b")
    reach = 1 if connectivity == 8 else 0
    touch = (F.col("a.f") == F.col("b.f")) & (F.col("b.y") == F.col("a.y") + 1) & (F.col("a.x1") <= F.col("b.x2") + reach) & (F.col("b.x1") <= F.col("a.x2") + reach)
    edges = a.join(b, touch).select(F.col("a.f").alias("f"), F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    edges = checkpointed(edges.unionByName(edges.select("f", F.col("v").alias("u"), F.col("u").alias("v"))))
    state = runs.select("f", "id", F.col("id").alias("root"))
    for _ in range(rounds):
        near = edges.join(state.select("f", F.col("id").alias("v"), "root"), ["f", "v"]).groupBy("f", F.col("u").alias("id")).agg(F.min("root").alias("near"))
        moved = state.join(near, ["f", "id"], "left").select("f", "id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("to"))
        up = moved.select("f", F.col("id").alias("to"), F.col("to").alias("above"))
        new = checkpointed(moved.join(up, ["f", "to"]).select("f", "id", "old", F.least("to", "above").alias("root")))
        state = new.select("f", "id", "root")
        if new.where("root != old").isEmpty():
            break
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")
    ranked = state.withColumn("label", F.dense_rank().over(Window.partitionBy("f").orderBy("root")))
    return runs.join(ranked, ["f", "id"]).select("f", F.explode(F.sequence("x1", "x2")).alias("x"), "y", F.col("label").cast("int").alias("label"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """labelled: f, label, v, coherence, is_max per pixel. Background (0) is left out."""
    inside = labelled.where("label > 0")
    return inside.groupBy("f", "label").agg(
        F.count("*").alias("size"), F.sum("v").alias("volume"), F.sum(1 - F.col("coherence") * F.col("coherence")).alias("incoherence"), F.count_if("is_max").alias("maximas")
    )


def score(size: Column, incoherence: Column, maximas: Column) -> Column:
    """Small, incoherent components with a maximum score near 1."""
    return F.when(maximas > 0, (1 - logistic(size, 40.0, 15.0, 0.9)) * logistic(incoherence / size, 0.4, 0.3, 0.9)).otherwise(0.0)


def score_v1(size: Column, incoherence: Column, maximas: Column, scale: float = 100.0) -> Column:
    """The earlier form: s / (s + 1), s = scale * incoherence / size^2 / maxima + epsilon."""
    s = F.when(maximas > 0, scale * incoherence / (size * size) / maximas).otherwise(0.0) + 2.0**-52
    return s / (s + 1)


def scored_pixels(labelled: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds to pixels (f, label) their component's score from (f, label, score): 0 for background and for scores that are no number."""
    joined = labelled.join(scores.select("f", "label", F.col("score").alias("score_")), ["f", "label"], "left")
    return joined.withColumn("score", F.when((F.col("label") > 0) & ~F.isnan("score_"), F.coalesce("score_", F.lit(0.0))).otherwise(0.0)).drop("score_")


def score_sets(scores: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Adds set_id: 0 for scores above the threshold, 1 for those up to it, null for what is no number (in neither set)."""
    return scores.withColumn("set_id", F.when(F.isnan("score"), F.lit(None)).when(F.col("score") > threshold, 0).otherwise(1))


def bounding_boxes(labelled: DataFrame) -> DataFrame:
    return labelled.where("label > 0").groupBy("f", "label").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def finger_or_object(stats: DataFrame) -> DataFrame:
    """A component with exactly one maximum is a finger (F0, F1, ... per frame), any other an object (O0, ...)."""
    kind = F.when(F.col("maximas") == 1, "F").otherwise("O")
    order = Window.partitionBy("f", "kind").orderBy("label")
    return stats.withColumn("kind", kind).withColumn("name", F.concat("kind", (F.row_number().over(order) - 1).cast("string")))
