"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.session import checkpointed, shared_folder, ship_package as python_ready

__all__ = ["WHITE_SPACE", "checkpointed", "join_small", "python_ready", "quoted", "read_table", "released", "shared_folder", "shielded"]

#: Words are maximal runs of anything but these six characters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str, rows: int = 20_000, megabytes: int = 8) -> DataFrame:
    """Join with a broadcast if the checkpointed side is measured to have at most so many rows and bytes, else by shuffle."""
    size = F.sum(sum((F.octet_length(F.to_json(F.struct(c))) for c in map(quoted, small.columns)), F.lit(0)))
    count, bytes_ = small.limit(rows + 1).agg(F.count("*"), size).first()
    return big.join(F.broadcast(small) if count <= rows and (bytes_ or 0) <= megabytes << 20 else small, on, how)


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files that nothing refers to any more, before the next round writes its own."""
    gc.collect()
    spark._jvm.System.gc()


def shielded(docs: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """docs with the columns beside keep under names that no operator uses, and the columns that restore the names and order."""
    names = {c: c if c in keep else f"other{i}__" for i, c in enumerate(docs.columns)}
    return docs.select(*(quoted(c).alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]
