"""What operators need of the running session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bounds of Arrow batches, so that a worker's memory doesn't follow the length of texts or frames.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per Spark application; needed where they don't share the driver's folders.

    Batches get their bounds where the session names none; a session's own are left as they are. All operators use the
    same, so that plans that run later don't depend on which was made last.
    """
    for key, value in BATCH_BOUNDS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_tactigrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tactigrid-")) / "tactigrid.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"tactigrid/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._tactigrid_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session without one (tests) gets a temporary one, a cluster an error."""
    context = spark.sparkContext
    if found := context.getCheckpointDir():
        return found
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: lineage ends there, a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
