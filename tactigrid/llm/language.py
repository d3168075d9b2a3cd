"""Language identification by nearest centroid.

A document is a vector of hashed character n-grams (1 to 3 letters of the lower-cased text, words parted by one space),
weighted by (1 + log count) * idf and normalised. Every language has several centroids, from spherical k-means over its
training vectors; a document gets the language of the centroid with the largest cosine. If even that cosine is below
what nearly all training documents of the language reach, the prediction is marked as rejected.

The fit learns every language that has labelled rows. It reads a bounded sample of those it may use
(`sample_per_language`, chosen by a hash of the id), and fits each language in a task of its own; what reaches the driver
is the centroids and one number per bucket. Prediction reads every whole text and nothing else.

Defined results: a text that is null or has no letter is `und` with score 0 and rejected; without any training row all
are `und`; repeated rows are predicted each; a null doc_id is never held out and never trains; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed, join_small, python_ready

UNKNOWN = "und"


_NO_LETTERS = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1)
def _other_word_characters() -> dict[int, str]:
    """What Python takes for word characters that are neither letters nor digits (fractions, enclosed numbers), each to a space: rare, and over a thousand."""
    return {ord(c): " " for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}


def _letters(text: str) -> str:
    """Lower-cased, with one space for every run of anything but letters."""
    text, others = text.lower(), _other_word_characters()
    if not text.isascii() and not others.keys().isdisjoint(map(ord, set(text))):
        text = text.translate(others)
    return _NO_LETTERS.sub(" ", text).strip()


@dataclass(frozen=True)
class LanguageParams:
    buckets: int = 8192
    centroids: int = 4
    #: About so many training rows of each language are read.
    sample_per_language: int = 400
    rounds: int = 8
    #: Share of training documents that fall below the rejection cosine.
    reject_share: float = 0.005
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # languages x centroids, buckets
    limits: np.ndarray  # by language


def ngram_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a text; (empty, empty) without letters."""
    letters = _letters(text)
    if not letters:
        return np.empty(0, np.int64), np.empty(0)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    one = points * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + one[2:]
    shift = np.uint64(64 - (buckets - 1).bit_length())
    spread = np.uint64(0xD6E8FEB86659FD93)
    counts = sum(np.bincount(((g ^ (g >> np.uint64(32))) * spread >> shift).astype(np.int64), minlength=buckets) for g in (one, two, three))
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


def _vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[found]
    return values / max(float(np.linalg.norm(values)), 1e-12)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _kmeans(vectors: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Unit centroids; fewer than k distinct vectors give repeated ones."""
    chosen = [int(rng.integers(len(vectors)))]
    while len(chosen) < k:
        far = 1 - (vectors @ vectors[chosen].T).max(1)
        chosen.append(int(far.argmax()))
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.stack([vectors[own == c].sum(0) if (own == c).any() else centroids[c] for c in range(k)])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """docs: the rows that may be learned from, with doc_id, text and lang."""
    spark = docs.sparkSession
    python_ready(spark)
    usable = docs.where("lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    share = checkpointed(usable.groupBy("lang").agg(F.least(F.lit(1.0), params.sample_per_language / F.count("*")).alias("share")))
    unit = (F.xxhash64("doc_id", F.lit(params.seed)).cast("double") / 2.0**64) + 0.5
    sample = join_small(usable, share, "lang", "inner").where(unit < F.col("share")).select("doc_id", "lang", "text")
    buckets = params.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [ngram_counts(t or "", buckets) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([e[0].astype(np.int32).tobytes() for e in each], pa.binary()), pa.array([e[1].astype(np.float32).tobytes() for e in each], pa.binary())], names=["doc_id", "lang", "found", "counts"])

    counted = checkpointed(sample.mapInArrow(count, "doc_id long, lang string, found binary, counts binary").where("length(found) > 0"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for found in batch.column("found").to_pylist():
                seen[np.frombuffer(found, np.int32)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["bucket", "n"])

    sums = {r["bucket"]: r["n"] for r in counted.mapInArrow(documents, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one per bucket
    seen = np.zeros(buckets)
    total = sums.pop(-1, 0)
    seen[list(sums)] = list(sums.values())
    idf = np.log((1 + total) / (1 + seen)) + 1

    def learn(table: pa.Table) -> pa.Table:
        name = table.column("lang")[0].as_py()
        own = sorted(zip(table.column("doc_id").to_pylist(), table.column("found").to_pylist(), table.column("counts").to_pylist(), strict=True))
        vectors = np.zeros((len(own), buckets), np.float32)
        for j, (_, found, n) in enumerate(own):
            at = np.frombuffer(found, np.int32)
            vectors[j, at] = _vector(at, np.frombuffer(n, np.float32).astype(float), idf)
        centroids = _kmeans(vectors, params.centroids, params.rounds, np.random.default_rng((params.seed, zlib.crc32(name.encode())))).astype(np.float32)
        limit = float(np.quantile((vectors @ centroids.T).max(1), params.reject_share))
        return pa.table({"lang": [name], "centroids": pa.array([centroids.tobytes()], pa.binary()), "limit": [limit]})

    learned = sorted(counted.groupBy("lang").applyInArrow(learn, "lang string, centroids binary, limit double").collect(), key=lambda r: r["lang"])  # one row per language
    centroids = np.frombuffer(b"".join(r["centroids"] for r in learned), np.float32).reshape(-1, buckets)
    return LanguageModel(tuple(r["lang"] for r in learned), idf, centroids, np.array([r["limit"] for r in learned]))


def predict(docs: DataFrame, model: LanguageModel, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected."""
    python_ready(docs.sparkSession)
    names = np.array(model.names, object)
    table = np.ascontiguousarray(model.centroids.T)  # buckets, languages x centroids
    idf, limits, k, buckets = model.idf, model.limits, params.centroids, params.buckets

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column("text").to_pylist():
                found, counts = ngram_counts(text or "", buckets)
                if not len(found) or not len(names):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                cosines = _vector(found, counts, idf).astype(np.float32) @ table[found]
                best = int(cosines.argmax())
                langs.append(names[best // k])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
                rejected.append(bool(cosines[best] < limits[best // k]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(guess, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Every document's predicted language; learned only from labelled rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), params)
    return predict(docs, model, params).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
