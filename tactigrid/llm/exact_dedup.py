"""Exact duplicates by a minimal perfect hash over the distinct digests of history.

A text's digest is the SHA-256 of its UTF-8 bytes, unchanged. The index of history is a table of shards: a shard holds the
distinct digests that fall to it (SHA-256 spreads them evenly), a minimal perfect hash of them, and in
the slot that the hash gives to a digest the digest itself, its winner's locator (the largest doc_id) and its number of rows.

The hash is a cascade of bit arrays: a level gives every key that is left a place in an array of `spread` bits a key; keys that
have a place for themselves set its bit, the others go on to the next level. A key's slot is the number of bits set before its own,
so n digests have the slots 0 to n - 1. A digest outside history may be given a slot too: only its comparison with all 32
bytes in that slot makes it a member.

Arriving rows go to the shard of their digest, unmerged; a shard that gets far more rows than the average (copies of one text) is
copied, and its rows are dealt to the copies, so one text may hold any share of the rows. Members are removed as repeats
and counted by their slot, which knows the winner so far; the others are grouped by digest, apart. Verdicts go back to the rows by slot or
digest: of common groups, each over a hundred-thousandth of all rows and so fewer than that, in a broadcast, of all others in a shuffle join.

Texts are read once, where they are: nothing but digests and identifiers crosses the network.

Defined results: a null text is the empty text; a null doc_id is smaller than any other, and stays only if its text has no
other; rows with one doc_id and one text are one document, which stay or go together and are counted each; an empty table or
history gives no rows or no members; other columns are ignored by `exact_duplicates` and kept, under any name, by `kept_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed, python_ready, shielded

_SHARD = "shard long, n int, places binary, sizes array<int>, digests binary, winners binary, counts binary"
_SEEN = "doc_id long, digest binary, slot long, winner long, n long"
#: In place of a null doc_id in the slots.
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class DedupParams:
    #: Distinct digests of a shard, about.
    shard_digests: int = 32_768
    #: A shard with more than so many times the average shard's rows is copied, if it is common too.
    shard_rows: float = 2.0
    #: Bits of a level for each key that reaches it.
    spread: float = 2.0
    levels: int = 64
    #: A shard or group counts as common from one of so many parts of all rows, so that there are fewer of them than that.
    most_common: int = 100_000
    #: Groups of at most so many rows are never common.
    common_rows: int = 1000


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Places in an array of so many bits, from all four words of a digest."""
    x = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k in range(4):
        x = (x ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return (x % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """Of n distinct digests: their slots, 0 to n - 1. bits: of all levels, one after the other; sizes: of the levels."""

    bits: np.ndarray
    sizes: tuple[int, ...]

    @staticmethod
    def of(digests: np.ndarray, params: DedupParams) -> PerfectHash:
        left, bits, sizes = _words(digests), [], []
        while len(left):
            if len(sizes) == params.levels:
                raise RuntimeError(f"{len(left)} digests found no place of their own in {params.levels} levels")
            size = max(64, int(params.spread * len(left)))
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        return PerfectHash(np.concatenate(bits) if bits else np.empty(0, bool), tuple(sizes))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A digest's slot; -1 for some of those that aren't in the index, any slot for others."""
        rank, out, left, begin = np.cumsum(self.bits) - 1, np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
        words = _words(digests)
        for level, size in enumerate(self.sizes):
            at = begin + _places(words[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = rank[at[hit]]
            left, begin = left[~hit], begin + size
        return out


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of 32-byte digests as an array of n rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def build_index(history: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """The shards of the distinct digests of history (doc_id, digest), one row each."""
    python_ready(history.sparkSession)
    distinct = checkpointed(history.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n")))
    shards = max(1, -(-distinct.count() // params.shard_digests))

    def build(table: pa.Table) -> pa.Table:
        own = _rows(table.column("digest"))
        found = PerfectHash.of(own, params)
        order = np.argsort(found.slots(own))
        numbers = [np.asarray(table.column(c).fill_null(_NONE)).astype(np.int64)[order].tobytes() for c in ("winner", "n")]
        row = {"shard": table.column("shard")[0].as_py(), "n": len(own), "places": np.packbits(found.bits).tobytes(), "sizes": list(found.sizes), "digests": own[order].tobytes(), "winners": numbers[0], "counts": numbers[1]}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("sizes", pa.list_(pa.int32())), ("digests", pa.binary()), ("winners", pa.binary()), ("counts", pa.binary())]))

    return checkpointed(distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, _SHARD))


def look_up(arrivals: DataFrame, index: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """Every row of arrivals (doc_id, digest) with its slot in the index, that slot's winner and number of rows; null for nonmembers."""
    python_ready(arrivals.sparkSession)
    shards = max(1, (index.agg(F.max("shard")).first()[0] or 0) + 1)
    keyed = arrivals.withColumn("shard", _shard(shards))
    loads = checkpointed(keyed.groupBy("shard").agg(F.count("*").alias("rows")))  # a row a shard
    total, average = loads.agg(F.sum("rows"), F.avg("rows")).first()
    most = max(params.shard_rows * (average or 1), (total or 0) / params.most_common)
    busy = F.broadcast(loads.where(F.col("rows") > most).select("shard", F.ceil(F.col("rows") / most).cast("long").alias("copies")))
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    dealt = keyed.join(busy, "shard", "left").withColumn("copy", F.pmod(F.monotonically_increasing_id(), copies)).drop("copies")
    spread = index.join(busy, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies")

    def find(rows: pa.Table, shard: pa.Table) -> pa.Table:
        asked, slots, winners, counts = _rows(rows.column("digest")), np.full(rows.num_rows, -1, np.int64), np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        number = rows.column("shard")[0].as_py() if rows.num_rows else 0
        if shard.num_rows and rows.num_rows:
            own = shard.to_pylist()[0]
            bits = np.unpackbits(np.frombuffer(own["places"], np.uint8))[: sum(own["sizes"])].astype(bool)
            slots = PerfectHash(bits, tuple(own["sizes"])).slots(asked)
            held = np.frombuffer(own["digests"], np.uint8).reshape(-1, 32)
            slots[(held[slots] != asked).any(1)] = -1  # a slot of -1 is compared with the last and fails, as it isn't a member
            winners, counts = (np.frombuffer(own[c], np.int64)[slots] for c in ("winners", "counts"))
        member = slots >= 0
        return pa.table({
            "doc_id": rows.column("doc_id"), "digest": rows.column("digest"),
            "slot": pa.array(number << 32 | slots, mask=~member), "winner": pa.array(winners, mask=~member | (winners == _NONE)), "n": pa.array(counts, mask=~member),
        })

    return dealt.groupBy("shard", "copy").cogroup(spread.groupBy("shard", "copy")).applyInArrow(find, _SEEN)


def _told(rows: DataFrame, groups: DataFrame, key: str, most: int) -> DataFrame:
    """rows with keep_id and group_size of their group; groups of more than `most` rows meet theirs by broadcast."""
    common, others = groups.where(F.col("group_size") > most), groups.where(F.col("group_size") <= most)
    frequent = F.broadcast(common.select(F.col(key), F.struct("keep_id", "group_size").alias("told")))
    marked = checkpointed(rows.join(frequent, key, "left"))
    near = marked.where("told is not null").select("doc_id", "digest", "told.keep_id", "told.group_size")
    return near.unionByName(marked.where("told is null").drop("told").join(others, key).select("doc_id", "digest", "keep_id", "group_size"))


def _verdicts(made: DataFrame, index: DataFrame, params: DedupParams, among: bool) -> DataFrame:
    """among: history's rows are among those of made, and so are counted there."""
    seen = checkpointed(look_up(made, index, params))
    most = max(params.common_rows, seen.count() // params.most_common)
    members, strangers = seen.where("slot is not null"), seen.where("slot is null")
    rows, before = F.count("*"), F.lit(0) if among else F.max("n")
    repeats = checkpointed(members.groupBy("slot").agg(F.greatest(F.max("doc_id"), F.max("winner")).alias("keep_id"), (rows + before).alias("group_size"), rows.alias("rows")))
    groups = checkpointed(strangers.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), rows.alias("group_size"), rows.alias("rows")))
    found = _told(members, repeats, "slot", most).unionByName(_told(strangers, groups, "digest", most))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def against_history(docs: DataFrame, index: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """One row per row of docs, none of which history holds: doc_id, keep_id, group_size, kept, text_sha256, over docs and history."""
    return _verdicts(checkpointed(digests(docs)), index, params, among=False)


def exact_duplicates(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The lower half of the range of doc_id is history to all rows."""
    made = checkpointed(digests(docs))
    low, high = made.agg(F.min("doc_id"), F.max("doc_id")).first()
    history = made.where(F.col("doc_id") <= (low + high) // 2) if low is not None else made.limit(0)
    return _verdicts(made, build_index(history, params), params, among=True)


def kept_documents(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """docs without the rows whose text stays under another doc_id, all columns as they are."""
    rest, names = shielded(docs, ["doc_id", "text"])
    gone = exact_duplicates(docs, params).where("not kept").select(F.col("doc_id").alias("gone_id__"), F.unhex("text_sha256").alias("gone_digest__")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id__")) & (digest_of(F.col("text")) == F.col("gone_digest__"))
    return rest.join(gone, same, "left_anti").select(*names)
