"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are quantised to integers and packed into blocks of at most `block_rows`, and every block gets an index when it is
packed: each dimension's rows in ascending order of their component, cut into posting segments by the component's
quantised size (`levels` equal steps between the dimension's extremes). A row's impact for a query is the query's weight
times the component's excess over the dimension's smallest value (for a negative weight, its shortfall from the largest), so
it is never negative, and a dimension's segments descend in impact from one of its two ends.

Per query, all segments are ordered by the largest impact that they hold and processed in that order, some at a time:
their rows' accumulators grow by the exact impacts. A row can still gain at most the largest unread impact of every
dimension in which it hasn't been read. Once the k-th best accumulator (of this block, or of blocks met before in the same
task) exceeds what all but some rows can still reach, these are possible members; once rescoring them exactly costs less than
reading on, that is done. The bound is the only reason to leave out a row. Accumulators are doubles; the bound allows for their rounding.

Queries are packed into blocks too, and each block of queries meets each group of vector blocks once, in an equi-join on
the group: a stated query set against all rows, in blocks. Each meeting returns k rows per query; a window keeps the best.

Defined results: vectors that are null, or hold nulls or non-finite components, take no part; shorter vectors count as
padded with zeros; ties go to the smaller vec_id; repeated rows are candidates each; a null vec_id takes no part; scores
beyond 64 bits are held at their limits; a query never finds rows of its own vec_id; with fewer candidates than k, all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed, python_ready


@dataclass(frozen=True)
class SearchParams:
    k: int = 5
    #: Queries are the rows whose vec_id this divides.
    query_every: int = 50
    scale: int = 256
    block_rows: int = 8192
    query_rows: int = 512
    #: Posting segments of a dimension in a block.
    levels: int = 32
    #: Shares of a query's postings after which it is asked whether to stop.
    turns: tuple[float, ...] = (0.1, 0.35, 0.6, 0.75, 0.85, 0.93, 1.0)
    #: Possible members per query (beyond k) that are always rescored; else as many as cost half of what is unread.
    spare: int = 32


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, q: array<double> of whole numbers."""
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(~bad).select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("q"))


@dataclass(frozen=True)
class Postings:
    """Index of a block of vectors, by dimension: rows in ascending order of value, their values, and where segments begin."""

    rows: np.ndarray  # dims, n
    values: np.ndarray  # dims, n
    begins: np.ndarray  # dims, levels + 1

    @classmethod
    def of(cls, table: np.ndarray, levels: int) -> Postings:
        columns = np.ascontiguousarray(table.T)
        rows = np.argsort(columns, axis=1, kind="stable")
        values = np.take_along_axis(columns, rows, 1)
        low, high = values[:, :1], values[:, -1:]
        width = high / levels - low / levels
        steps = low + width * np.arange(levels)  # lower bound of each segment
        begins = np.stack([np.searchsorted(v, s, "left") for v, s in zip(values, steps, strict=True)])
        begins[:, 0] = 0
        return cls(rows, values, np.maximum.accumulate(np.column_stack([begins, np.full(len(rows), table.shape[0])]), axis=1).astype(np.int32))


def packed(vectors: DataFrame, rows: int, key: str, levels: int = 0) -> DataFrame:
    """Rows (key, n, dims, ids, values, and with levels the postings' rows and begins): up to `rows` vectors of one task and one key, as little-endian bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(group: int) -> pa.RecordBatch:
            own = waiting.pop(group)
            dims = max(1, max(len(v) for _, v in own))
            values = np.zeros((len(own), dims))
            for i, (_, v) in enumerate(own):
                values[i, : len(v)] = v
            index = Postings.of(values, levels) if levels else None
            parts = [np.array([i for i, _ in own], np.int64), values, *([index.rows.astype(np.int32), index.begins] if index else [])]
            names = ["ids", "values", *(["rows", "begins"] if index else [])]
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([dims], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=[key, "n", "dims", *names])

        for batch in batches:
            column = batch.column("q")
            flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, (vec, group) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column(key).to_pylist(), strict=True)):
                own = waiting.setdefault(group, [])
                own.append((vec, flat[at[i] : at[i + 1]]))
                if len(own) >= rows:
                    yield block(group)
        for group in list(waiting):
            yield block(group)

    return vectors.mapInArrow(pack, f"{key} long, n int, dims int, ids binary, values binary" + (", rows binary, begins binary" if levels else ""))


def _best(values: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best rows, by Python integers where doubles could round; held within 64 bits."""
    if values.size and float(np.abs(values).max(initial=0)) * float(np.abs(query).sum()) >= 2.0**53:
        scores = [min(max(sum(int(a) * int(b) for a, b in zip(row, query, strict=True)), -(2**63)), 2**63 - 1) for row in values]
        return [(-s, v) for s, v in sorted(zip((-s for s in scores), ids.tolist(), strict=True))[:k]]
    scores = values @ query
    order = np.lexsort((ids, -scores))[:k]
    return [(int(s), int(v)) for s, v in zip(scores[order], ids[order], strict=True)]


def _possible(index: Postings, query: np.ndarray, skip: np.ndarray, floor: float, params: SearchParams) -> tuple[np.ndarray, int]:
    """(rows that may be among the k best of the block and above floor, postings that were read)."""
    dims, n = index.rows.shape
    levels = index.begins.shape[1] - 1
    used = np.flatnonzero((query != 0) & (index.values[:, 0] < index.values[:, -1]))
    high, low = index.values[:, -1], index.values[:, 0]
    scale = 2.0 ** -max(0, int(np.frexp(max(np.abs(high).max(), np.abs(low).max()))[1]) + int(np.frexp(np.abs(query).max())[1]) - 960)
    q = query * scale
    base = float(np.where(q >= 0, q * low, q * high).sum())
    weight, up = np.abs(q[used]), q[used] > 0
    top, bottom, begins = high[used], low[used], index.begins[used]
    slack = 1e-12 * (abs(base) + float((np.abs(q) * (np.abs(high) + np.abs(low))).sum()))
    need_floor = floor * scale - base
    # Segments in the order in which their dimension is read: from the top, or for negative weights from the bottom.
    order = np.where(up[:, None], np.arange(levels)[::-1], np.arange(levels))
    sizes = np.take_along_axis(np.diff(begins, axis=1), order, 1)
    read_to = np.concatenate([np.zeros((len(used), 1), np.int64), np.cumsum(sizes, 1)], 1)  # postings of a dimension before its j-th segment
    at = np.minimum(read_to, n - 1)
    first = np.take_along_axis(index.values[used], np.where(up[:, None], n - 1 - at, at), 1)  # largest impact from there on
    impact = weight[:, None] * np.where(up[:, None], first - bottom[:, None], top[:, None] - first)
    impact[read_to >= n] = 0
    queue = np.argsort(-impact[:, :levels], axis=None, kind="stable")
    done = np.cumsum(sizes.ravel()[queue])
    partial, now = np.zeros(n), np.zeros(len(used), np.int64)
    seen: list[np.ndarray] = []
    seen_dims: list[int] = []
    lengths: list[int] = []
    for share in params.turns:
        upto = min(int(np.searchsorted(done, done[-1] * share, "left")) + 1, len(queue))
        ahead = np.bincount(queue[:upto] // levels, minlength=len(used))  # a dimension's segments descend, so these are its first ones
        rows, gains = [], []
        for d in np.flatnonzero(ahead > now).tolist():
            a, b = int(read_to[d, now[d]]), int(read_to[d, ahead[d]])
            part = slice(n - b, n - a) if up[d] else slice(a, b)
            values = index.values[used[d], part]
            rows.append(index.rows[used[d], part])
            gains.append((values - bottom[d]) * weight[d] if up[d] else (top[d] - values) * weight[d])
            seen_dims.append(d)
            lengths.append(b - a)
        now = ahead
        if rows:
            seen.append(np.concatenate(rows))
            partial += np.bincount(seen[-1], np.concatenate(gains), n)
        ahead_of = impact[np.arange(len(used)), now]
        known = np.where(skip, -np.inf, partial)
        kth = np.partition(known, n - params.k)[n - params.k] if n > params.k else -np.inf
        need = max(kth, need_floor) - slack
        unread = int(done[-1] - done[upto - 1])
        if unread and float(partial.mean()) + unread / done[-1] * float(ahead_of.sum()) >= need:
            continue  # the average row can still be among the best: too early to ask each
        reach = partial + ahead_of.sum()
        if ahead_of.any():
            reach -= np.bincount(np.concatenate(seen), np.repeat(ahead_of[seen_dims], lengths), n)
        possible = np.flatnonzero((reach >= need) & ~skip)
        if len(possible) <= max(params.k + params.spare, unread / (2 * dims)):  # rescoring these costs less than reading on
            break
    return possible, int(done[upto - 1])


def block_top(values: np.ndarray, index: Postings, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, params: SearchParams) -> tuple[list[list[tuple[int, int]]], int]:
    """Per query, (score, vec_id) of its best k rows of the block, best first (rows that score below floor may be missing), and the postings that were read."""
    out, read, varied = [], 0, index.values[:, 0] < index.values[:, -1]
    for query, self_id, least in zip(queries, own.tolist(), floor.tolist(), strict=True):
        skip = ids == self_id
        if varied[query != 0].any():
            rows, n = _possible(index, query, skip, least, params)
            read += n
        else:
            rows = np.flatnonzero(~skip)  # all score the same
        out.append(_best(values[rows], ids[rows], query, params.k))
    return out, read


def top_k(vectors: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of every query, its best k other rows."""
    spark = vectors.sparkSession
    python_ready(spark)
    whole = quantised(vectors, params.scale)
    n = whole.count()
    groups = max(1, min(-(-n // params.block_rows), 100_000))
    keyed = whole.withColumn("group", F.pmod(F.xxhash64("vec_id", "q"), F.lit(groups)))
    index = packed(keyed.repartition(groups, "group"), params.block_rows, "group", params.levels)
    asked = whole.where(F.col("vec_id") % params.query_every == 0).dropDuplicates(["vec_id", "q"])
    blocks = checkpointed(packed(asked.withColumn("part", F.lit(0).cast("long")).coalesce(max(1, groups // 8)), params.query_rows, "part"))
    spread = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), *(F.col(c).alias(f"q_{c}") for c in ("n", "dims", "ids", "values")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}  # k-th best score so far of the queries of a block, in this task
        for batch in batches:
            for r in batch.to_pylist():
                dims = max(r["dims"], r["q_dims"])

                def table(count: int, width: int, data: bytes) -> np.ndarray:
                    found = np.frombuffer(data).reshape(count, width)
                    return np.pad(found, ((0, 0), (0, dims - width))) if width < dims else found  # noqa: B023

                values = table(r["n"], r["dims"], r["values"])
                if r["dims"] < dims:  # no weight of a longer query meets anything but zeros there
                    index = Postings.of(values, params.levels)
                else:
                    order = np.frombuffer(r["rows"], np.int32).reshape(dims, r["n"]).astype(np.int64)  # what sums by row take
                    index = Postings(order, np.take_along_axis(values.T, order, 1), np.frombuffer(r["begins"], np.int32).reshape(dims, -1))
                ids, own = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                if len(best) > 1000:
                    best.clear()
                floor = best.get(r["q_ids"], np.full(len(own), -np.inf))
                found, _ = block_top(values, index, ids, table(r["q_n"], r["q_dims"], r["q_values"]), own, floor, params)
                best[r["q_ids"]] = np.array([max(f, s[params.k - 1][0]) if len(s) >= params.k else f for f, s in zip(floor, found, strict=True)])
                rows = [(q, v, s) for q, own_found in zip(own.tolist(), found, strict=True) for s, v in own_found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    met = index.join(spread, "group").drop("group").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
