"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts makes, per document, the set of its shingle hashes, a digest of the set, 240 minima, the hashes
   of 24 bands of 6 minima, and a signature that keeps 4 low bits of every minimum, packed into 120 bytes.
2. Documents with equal sets are one class with one representative; only representatives go on.
3. Representatives that share a band are candidates. Pairs are not listed: in every band bucket one leader is paired
   with the others. A pair's similarity is estimated from the bit counts of its signatures, corrected for the chance
   agreement of 4-bit values; pairs far below the threshold are dropped, the others are confirmed on full shingle sets.
4. Confirmed links are contracted to components. The next rounds choose other leaders and look only at buckets that
   still hold several components; the last round takes every remaining pair of different components that share a
   bucket, once, in the first bucket that they share. So no link that could change a component is left out, and groups of copies never become all pairs.
   Texts over one template, each with edits of its own, are near each other without being linked: there each document's shingles
   that no other document of the round has are counted, and pairs that these alone keep below the threshold are never made.

Chances to miss, at similarity 0.85 exactly: 1 - (1 - 0.85^6)^24 leaves 1.2e-5 of pairs without a shared band; the
estimate has a standard error of 0.024 there and its cut lies 5 of them below, which leaves 2.2e-7.

Defined results: see `near_duplicates`. Words are runs of anything but ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed, python_ready, quoted, released
from tactigrid.llm.graph import components

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_NIBBLES = 0x1111111111111111
#: Words whose hashes a worker keeps; beyond that it starts anew.
CACHED_WORDS = 300_000


@dataclass(frozen=True)
class MinHashParams:
    width: int = 5
    #: Link if 100 * intersection >= percent * union.
    percent: int = 85
    bands: int = 24
    rows: int = 6
    #: Minima that are kept as 4 bits each; a multiple of 16, at least bands * rows.
    signature: int = 240
    #: Pairs with a lower estimate aren't confirmed.
    least_estimate: float = 0.72
    #: Rounds with one leader per bucket, before the round that takes all remaining pairs.
    leader_rounds: int = 3
    seed: int = 5

    @property
    def words(self) -> int:
        """64-bit words of a signature."""
        return self.signature // 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer words than width, of the whole sequence; empty without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    wide = min(width, len(words))
    run = each[: len(each) - wide + 1].copy()
    for k in range(1, wide):
        run = run * _PRIME + each[k : len(each) - wide + 1 + k]
    return np.unique(_mixed(run + np.uint64(wide)))


def minima(sets: list[np.ndarray], params: MinHashParams) -> np.ndarray:
    """One row of params.signature minima per (non-empty) set."""
    rng = np.random.default_rng(params.seed)
    a = rng.integers(1, 2**63, params.signature).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, params.signature).astype(np.uint64)
    out = np.empty((len(sets), params.signature), np.uint64)
    for i, s in enumerate(sets):
        low = None
        for k in range(0, len(s), 256):  # stays in the CPU's cache
            part = (s[None, k : k + 256] * a[:, None] + b[:, None]).min(1)
            low = part if low is None else np.minimum(low, part)
        out[i] = low
    return out


def band_hashes(low: np.ndarray, params: MinHashParams) -> np.ndarray:
    by_band = low[:, : params.bands * params.rows].reshape(len(low), params.bands, params.rows)
    run = np.broadcast_to(np.arange(1, params.bands + 1, dtype=np.uint64), by_band.shape[:2]).copy()
    for k in range(params.rows):
        run = _mixed(run * _PRIME + by_band[:, :, k])
    return run.view(np.int64)


def signatures(low: np.ndarray, params: MinHashParams) -> np.ndarray:
    """4 bits of every minimum, packed into 64-bit words."""
    bits = (_mixed(low) & np.uint64(15)).astype(np.uint8)
    return np.ascontiguousarray(bits[:, 0::2] << 4 | bits[:, 1::2]).view(np.int64).reshape(len(low), params.words)


def digests(docs: DataFrame, params: MinHashParams) -> DataFrame:
    """doc_id, n_shingles, set_digest (null for an empty set), bands, s0, s1, ..."""
    python_ready(docs.sparkSession)
    names = [f"s{k}" for k in range(params.words)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t or b"", hashes, params.width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            low = minima([sets[k] for k in full], params)
            index = np.full(len(sets), -1)
            index[full] = np.arange(len(full))
            take = pa.array(index, mask=index < 0)
            bands = pa.ListArray.from_arrays(np.arange(0, len(full) * params.bands + 1, params.bands, dtype=np.int32), pa.array(band_hashes(low, params).ravel()))
            packed = signatures(low, params)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            arrays = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), bands.take(take)]
            arrays += [pa.array(np.ascontiguousarray(packed[:, k])).take(take) for k in range(params.words)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_digest", "bands", *names])

    schema = "doc_id long, n_shingles long, set_digest binary, bands array<long>, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(digest, schema)


def estimate(a: str, b: str, params: MinHashParams) -> Column:
    """Similarity of the signatures in columns a_s0.. and b_s0..: share of equal 4-bit values, less what chance makes equal."""
    unequal = F.lit(0)
    for k in range(params.words):
        x = F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unequal += F.bit_count(x.bitwiseAND(F.lit(_NIBBLES)))
    equal = 1 - unequal / F.lit(float(params.signature))
    return (equal - 1 / 16) / (1 - 1 / 16)


def confirmed(pairs: DataFrame, texts: DataFrame, params: MinHashParams) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough. texts: id, text."""
    python_ready(pairs.sparkSession)
    left, right = (texts.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text")) for k in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, own = WordHashes(), None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a_text").cast(pa.binary()).to_pylist(), batch.column("b_text").cast(pa.binary()).to_pylist(), strict=True):
                if a != last:
                    last, own = a, shingle_set(a, hashes, params.width)
                other = shingle_set(b, hashes, params.width)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= params.percent * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long").distinct()


def unshared(texts: DataFrame, params: MinHashParams) -> DataFrame:
    """(id, own): how many shingles of a document's text no other document has; left out are documents without any, and those of several rows, whose texts may differ.

    Two shingles of one hash count as one that is shared, so own is never too high.
    """
    python_ready(texts.sparkSession)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes, params.width).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = np.repeat(batch.column("id").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["id", "shingle"])

    made = texts.select("id", "text").mapInArrow(shingles, "id long, shingle long")
    sole = made.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("high")).where(F.col("id") == F.col("high"))
    several = texts.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
    return sole.groupBy("id").agg(F.count("*").alias("own")).join(several, "id", "left_anti")


def _may_link(a: str, b: str, params: MinHashParams) -> Column:
    """Whether sets of columns a_n and b_n shingles, a_own and b_own of them in no other set, can be similar enough."""
    most = F.least(F.col(f"{a}n") - F.col(f"{a}own"), F.col(f"{b}n") - F.col(f"{b}own"))
    return (100 + params.percent) * most >= params.percent * (F.col(f"{a}n") + F.col(f"{b}n"))


def _shared(sharing: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(bucket, band, id, root): rows of buckets that hold several components."""
    if roots is None:
        return sharing.withColumn("root", F.col("id"))
    rooted = sharing.join(roots, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", F.coalesce("root", "id").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return rooted.join(several, "bucket")


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Rows with one doc_id
    are one document: they share a component and stay or go together. A null doc_id has no component and is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    made = checkpointed(digests(docs, params))
    signature = [f"s{k}" for k in range(params.words)]
    some = made.where("set_digest is not null and doc_id is not null")
    classes = some.groupBy("set_digest").agg(F.min("doc_id").alias("id"))
    signed = some.select(F.col("doc_id").alias("id"), "set_digest", F.col("n_shingles").alias("n"), "bands", *signature).join(classes, ["set_digest", "id"]).dropDuplicates(["set_digest"])
    signed = checkpointed(signed.drop("set_digest"))

    in_buckets = signed.select("id", F.posexplode("bands").alias("band", "bucket")).dropDuplicates(["id", "bucket"])
    crowded = in_buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("bucket", "leader")
    sharing = checkpointed(in_buckets.join(crowded, "bucket"))
    involved = sharing.select("id").distinct()
    texts = checkpointed(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").join(involved, "id", "left_semi"))
    left, right = (signed.select(F.col("id").alias(k), *(F.col(s).alias(f"{k}_{s}") for s in signature)) for k in "ab")
    near = estimate("a_", "b_", params) >= params.least_estimate

    roots = None
    for turn in range(params.leader_rounds + 1):
        released(docs.sparkSession)
        if turn == 0:
            pairs = sharing.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        else:
            shared = checkpointed(_shared(sharing, roots))
            if turn < params.leader_rounds:
                leader = shared.groupBy("bucket").agg(F.min_by(F.struct("id", "root"), F.xxhash64(F.col("id"), F.col("bucket"), F.lit(turn))).alias("l"))
                pairs = shared.join(leader, "bucket").where("root != l.root").select(F.col("l.id").alias("a"), F.col("id").alias("b")).distinct()
            else:
                rest = texts.join(shared.select("id").distinct(), "id", "left_semi")
                own = checkpointed(unshared(rest, params))
                one = shared.join(signed.select("id", "n", "bands", *signature), "id").join(own, "id", "left").fillna(0, ["own"])
                a, b = (one.select("bucket", "band", F.col("id").alias(k), F.col("root").alias(f"{k}_root"), F.col("n").alias(f"{k}_n"), F.col("own").alias(f"{k}_own"), F.col("bands").alias(f"{k}_bands"), *(F.col(s).alias(f"{k}_{s}") for s in signature)) for k in "ab")
                earlier = F.exists(F.arrays_zip(F.slice("a_bands", 1, a["band"]), F.slice("b_bands", 1, a["band"])), lambda x: x["0"] == x["1"])
                pairs = a.join(b, (a["bucket"] == b["bucket"]) & (F.col("a_root") < F.col("b_root")) & _may_link("a_", "b_", params) & near & ~earlier).select("a", "b").distinct()
        if turn < params.leader_rounds:
            pairs = pairs.join(right, "b").join(left, "a").where(near).select("a", "b")
        links = checkpointed(confirmed(pairs, texts, params))
        if roots is not None:
            old = roots.select("node", "root")
            over = links.join(old.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(old.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            links = over.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        new = components(links, "a", "b")
        if roots is None:
            roots = checkpointed(new)
        elif not new.isEmpty():
            moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = checkpointed(moved.unionByName(new.join(roots.select("node"), "node", "left_anti")))
    del shared, pairs, links, new
    released(docs.sparkSession)
    found = classes.join(roots, F.col("id") == F.col("node"), "left").select("set_digest", F.coalesce("root", "id").alias("root"))
    out = made.select("doc_id", "n_shingles", "set_digest").join(found, "set_digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """docs without those that are linked, directly or through others, with a document of a smaller doc_id."""
    gone = near_duplicates(docs, params).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
