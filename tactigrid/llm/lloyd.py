"""Plain Lloyd clustering of whole-number vectors, exact in every sum.

Components are turned into whole numbers once, and vectors packed into blocks of at most `block_rows`, written to the shared
folder. A round broadcasts the centroids (k times the dimensions, whatever the number of vectors) in the function that
mapInPandas runs: squared differences to one centroid after the other in 64-bit integers, the lowest index of the least, and the
sums of the partition's members by cluster and dimension, one row each. groupBy merges these sums, and k rows go to the
driver, where floor(sum / count) is taken in unbounded integers. So a round reads the blocks once, whatever share of
them one cluster holds, and shuffles k * dimensions numbers of every partition.

Defined results: vectors that are null, of another length, or hold nulls or non-finite components take no part; components beyond
2^27 in size are held there, so that every squared distance fits 64 bits; seeds are the rows with the least SHA-256 of
`<salt>:<vec_id>`, rows with a null vec_id after all others, ties by components; with fewer vectors than clusters there are as
many centroids as vectors; equal centroids leave all to the lower number; sums of distances beyond 64 bits are held at their limit; repeated rows are vectors each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed, python_ready

_LIMIT = 1 << 27


@dataclass(frozen=True)
class LloydParams:
    clusters: int = 8
    dims: int = 64
    scale: int = 1024
    rounds: int = 10
    salt: int = 3
    #: Vectors of a block; a block has its vectors' ids and components side by side.
    block_rows: int = 4096


def whole_vectors(vectors: DataFrame, params: LloydParams) -> DataFrame:
    """vec_id, q: array<int>, of the vectors that take part."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == params.dims)
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * params.scale, F.lit(2.0**40)), F.lit(-(2.0**40)))), F.lit(_LIMIT)), F.lit(-_LIMIT))
    return d.where(~bad).select("vec_id", F.transform("e", lambda x: held(x).cast("int")).alias("q"))


def seeds(whole: DataFrame, params: LloydParams) -> np.ndarray:
    """The first centroids: k rows, found by a top-k of the hashes."""
    digest = F.sha2(F.concat(F.lit(f"{params.salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = whole.select("q", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "q").limit(params.clusters).collect()
    return np.array([r["q"] for r in rows], np.int64).reshape(len(rows), params.dims)


def packed(whole: DataFrame, params: LloydParams) -> DataFrame:
    """Blocks, made where the vectors are: n, ids (64-bit), known (a byte each, 0 for a null id), q (32-bit rows)."""

    def block(held: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(held)
        return pd.DataFrame({"n": [len(d)], "ids": [d["vec_id"].to_numpy(np.int64).tobytes()], "known": [d["known"].to_numpy(bool).tobytes()], "q": [np.stack(d["q"].to_numpy()).astype(np.int32).tobytes()]})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            for k in range(0, len(frame), params.block_rows):
                part = frame.iloc[k : k + params.block_rows]
                if sum(map(len, held)) + len(part) > params.block_rows:
                    yield block(held)
                    held = []
                held.append(part)
        if held:
            yield block(held)

    given = whole.select(F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), F.col("vec_id").isNotNull().alias("known"), "q")
    return given.mapInPandas(pack, "n int, ids binary, known binary, q binary")


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row: the lowest number of the nearest centroids, and the squared distance."""
    apart = np.empty((len(centroids), len(values)), np.int64)
    for k, centroid in enumerate(centroids):
        difference = values - centroid
        apart[k] = np.einsum("ij,ij->i", difference, difference)
    cluster = apart.argmin(0)
    return cluster, apart[cluster, np.arange(len(values))]


def _round(blocks: DataFrame, centroids: np.ndarray, params: LloydParams) -> np.ndarray:
    """The centroids after one round."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for frame in frames:
            for data in frame["q"]:
                values = np.frombuffer(data, np.int32).astype(np.int64).reshape(-1, params.dims)
                cluster, _ = nearest(values, centroids)
                for k in np.unique(cluster):
                    own = values[cluster == k]
                    total[k] += own.sum(0)
                    count[k] += len(own)
        full = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": full.astype(np.int32).repeat(params.dims), "dim": np.tile(np.arange(params.dims, dtype=np.int32), len(full)), "total": total[full].ravel(), "n": count[full].repeat(params.dims)})

    merged = blocks.select("q").mapInPandas(sums, "cluster int, dim int, total long, n long").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = centroids.copy()
    for r in merged.collect():  # a row for each cluster and dimension
        new[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return new


def _held(total: object) -> int:
    return min(int(total), 2**63 - 1)


def cluster(vectors: DataFrame, params: LloydParams = LloydParams()) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    python_ready(spark)
    whole = whole_vectors(vectors, params)
    blocks = checkpointed(packed(whole, params))
    centroids = seeds(whole, params)
    for _ in range(params.rounds if len(centroids) else 0):
        centroids = _round(blocks, centroids, params)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, known, data in zip(frame["ids"], frame["known"], frame["q"], strict=True):
                found, distance = nearest(np.frombuffer(data, np.int32).astype(np.int64).reshape(-1, params.dims), centroids)
                yield pd.DataFrame({"vec_id": np.frombuffer(ids, np.int64), "known": np.frombuffer(known, bool), "cluster": found.astype(np.int32), "distance": distance})

    assigned = checkpointed(blocks.mapInPandas(assign, "vec_id long, known boolean, cluster int, distance long").withColumn("vec_id", F.when(F.col("known"), F.col("vec_id"))))
    by_cluster = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    told = [(k, _held(by_cluster.get(k, 0)), _held(sum(by_cluster.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
