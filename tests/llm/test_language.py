import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactigrid.llm import language


#: An id that isn't held out.
LEARNED = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 != 2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_reads_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shuffled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    predictions = lambda d: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d).collect()}
    assert predictions(docs) == predictions(shuffled)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, None, "en"), (3, "", None), (4, "123 !! ½ ² ① Ⅷ _", "en"), (None, "der Hund und die Katze", "de"), (LEARNED, "der Hund und die Katze", "de"), (LEARNED, "der Hund und die Katze", "de"), (6, "le chien " * 20000, None)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, share string")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and by[4]["score"] == 0 and by[4]["rejected"]
    assert by[None]["lang_pred"] == "de" and not by[None]["held_out"]
    nothing = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, chr(0x4E00 + i // 4) * 3, f"l{i // 4:03}") for i in range(4 * 230) if zlib.crc32(str(i).encode()) % 4 != 2]
    names = {lang for _, _, lang in rows}
    assert len(names) > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert set(model.names) == names
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) / len(rows) > 0.95


def test_predictions_equal_a_direct_nearest_centroid(spark):
    """n-grams counted one by one, vectors and cosines in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    k = language.LanguageParams().centroids
    assert model.centroids.shape == (k * len(model.names), 8192) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    bucket = {}  # of every n-gram alone: texts of one letter hold the n-grams of a word of it
    for r, row in zip(language.predict(docs, model).collect(), docs.collect(), strict=True):
        letters = " ".join("".join(c if c.isalpha() else " " for c in row["text"].lower()).split())
        grams = Counter(f" {letters} "[i : i + n] for n in (1, 2, 3) for i in range(len(letters) + 3 - n))
        counts = Counter()
        for g, n in grams.items():
            if g not in bucket:
                bucket[g] = gram_bucket(g)
            counts[bucket[g]] += n
        weights = {b: (1 + math.log(n)) * model.idf[b] for b, n in counts.items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * c[b] for b, w in weights.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r["lang_pred"] == model.names[best // k] and r["score"] == pytest.approx(cosines[best], abs=1e-4)
        assert r["rejected"] == (cosines[best] < model.limits[best // k]) or abs(cosines[best] - model.limits[best // k]) < 1e-4


def gram_bucket(gram):
    """The multiplicative hash of an n-gram's code points, with Python's integers."""
    m, h = 2**64 - 1, 0
    for i, (c, (shift, factor)) in enumerate(zip(gram, ((0, 0), (31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)), strict=False)):
        one = ord(c) * 0x9E3779B97F4A7C15 & m
        h = one if not i else ((h ^ h >> shift) * factor + one) & m
    return ((h ^ h >> 32) * 0xD6E8FEB86659FD93 & m) >> 51
