import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tactigrid.llm import empirical_bayes, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    half = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


ODD = ["a b c a b c a b c", "x\n\nx\n x\n \nx", "é ü #$%\x0bz\x1cq", "Straße 日本 𝔘𝔫𝔦 " * 30, "a" * 5000, " ".join(f"w{i % 40}" for i in range(60)), "\n".join(["same line here"] * 40)]


def test_measures_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-i, t, None) for i, t in enumerate([None, "", *ODD], 1)], "doc_id long, text string, lang string")
    every = docs.unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in every.collect()}
    got = quality_rules.apply_rules(every).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_distances_equal_brute_force(spark):
    params = quality_rules.QualityParams()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    refs = quality_rules.references(docs).collect()
    by_lang = {r["ref_lang_"]: r for r in refs}
    assert "*" in by_lang and all(sum(r["word_ref_"]) == pytest.approx(1) and sum(r["class_ref_"]) == pytest.approx(1) for r in refs)
    rows = docs.collect()
    counts = Counter(w.lower() for r in rows for w in WORD.findall(r["text"]) if re.search(r"[^\W_]", w))
    assert sorted(by_lang["*"]["common_"], key=lambda w: (-counts[w], w)) == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: params.common_words]
    got = {r["doc_id"]: r["word_distance"] for r in quality_rules.apply_rules(docs).collect()}
    for r in rows:
        w = WORD.findall(r["text"])
        if got[r["doc_id"]] is None:
            continue
        ref = by_lang.get(r["lang"], by_lang["*"])
        hist = Counter(x.lower() for x in w)
        common = [hist[c] for c in ref["common_"]]
        lone = sum(not re.search(r"[^\W_]", x) for x in w)
        p = [*(c / len(w) for c in common), lone / len(w), (len(w) - lone - sum(common)) / len(w)]
        assert got[r["doc_id"]] == pytest.approx(distance(p, ref["word_ref_"]), abs=1e-9)


def test_long_words_are_common_words_too(spark):
    df = spark.createDataFrame([(k, "wonderful extraordinary " * 30 + f"w{k} " * 40, "en") for k in range(40)], "doc_id long, text string, lang string")
    assert set(quality_rules.references(df).where("ref_lang_ = 'en'").first()["common_"][:2]) == {"wonderful", "extraordinary"}


def test_rules_reject_junk_and_keep_the_rest(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    long = quality_rules.apply_rules(docs.select("doc_id", "text", "lang")).where("not base_failed").join(labels, "doc_id")
    r = long.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {x["quality"]: x["kept"] for x in r}
    assert share[1] > 0.995 and share[0] < 0.05


def test_kept_documents_with_clashing_columns(spark):
    clean = " ".join(f"the word{i} of term{i} and" for i in range(40)) + "."
    df = spark.createDataFrame([(1, clean, "en", "k", 1), (2, "short", "en", "k", 2), (3, None, None, None, None)], "doc_id long, text string, lang string, kept string, n_words int").withColumnRenamed("n_words", "a.b `c`").withColumn("hits_", F.lit(1))
    got = quality_rules.kept_documents(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, clean, "en", "k", 1, 1)]
    assert quality_rules.apply_rules(df).count() == 3 and quality_rules.kept_documents(df.limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = empirical_bayes.score(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    good = [r for r in got if r["quality"] == 1]
    assert sum(r["kept"] for r in good) / len(good) > 0.99
    bad = [r for r in got if r["quality"] == 0]
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.9


def test_scores_equal_a_direct_computation(spark):
    """Evidence, both posteriors and the score, in plain Python from the fitted weights."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    params = empirical_bayes.BayesParams()
    table = empirical_bayes.measured(docs.select("doc_id", F.col("text")), ["doc_id"])
    model = empirical_bayes.train(table, labels, params)
    rows = {r["doc_id"]: r for r in docs.collect()}
    p = {}
    for i, r in rows.items():
        z = sum((x - m) / s * w for x, m, s, w in zip(empirical_bayes.measures((r["text"] or "").encode()), model.mean, model.scale, model.weights, strict=False)) + model.weights[-1]
        p[i] = 1 / (1 + math.exp(-min(30, max(-30, z))))
    mean = sum(p.values()) / len(p)
    groups = lambda key: {k: [p[i] for i in rows if key(rows[i]) == k] for k in {key(r) for r in rows.values()}}
    hosts, paths = groups(lambda r: r["source"]), groups(lambda r: (r["source"], r["lang"]))

    def strength(found):  # of (values, about) per group
        n = sum(len(v) for v, _ in found)
        means = [(len(v), sum(v) / len(v), about) for v, about in found]
        spread = max(0.0, (sum(k * (m - a) ** 2 for k, m, a in means) - sum(m * (1 - m) for _, m, _ in means)) / n)
        return min(params.most_strength, max(params.least_strength, mean * (1 - mean) / spread - 1 if spread > 0 else params.most_strength))

    top = strength([(v, mean) for v in hosts.values()])
    of_host = {h: (sum(v) + top * mean) / (len(v) + top) for h, v in hosts.items()}
    low = strength([(v, of_host[h]) for (h, _), v in paths.items()])
    of_path = {k: (sum(v) + low * of_host[k[0]]) / (len(v) + low) for k, v in paths.items()}
    logit = lambda q: math.log(min(max(q, 1e-9), 1 - 1e-9) / (1 - min(max(q, 1e-9), 1 - 1e-9)))
    got = empirical_bayes.score(docs, labels, params).collect()
    assert len(got) == len(rows)
    for r in got:
        d = rows[r["doc_id"]]
        want = 1 / (1 + math.exp(-(logit(p[d["doc_id"]]) + params.site_weight * (logit(of_path[(d["source"], d["lang"])]) - logit(mean)))))
        assert (r["evidence"], r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx((p[d["doc_id"]], of_host[d["source"]], of_path[(d["source"], d["lang"])], want), abs=1e-9)
        assert r["kept"] == (r["score"] >= params.threshold)


def test_posteriors_shrink(spark):
    rows = [("big", "en", 0.9)] * 400 + [("big", "de", 0.1)] * 400 + [("one", "en", 0.0)] + [("mid", "en", 0.2)] * 50 + [(None, None, 0.5)] * 3
    got = {(r["host"], r["path"]): r for r in empirical_bayes.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    mean = sum(p for *_, p in rows) / len(rows)
    assert abs(got[("one", "en")]["host_posterior"] - mean) < abs(0 - mean) * 0.2
    assert got[("big", "en")]["path_posterior"] > 0.7 > 0.3 > got[("big", "de")]["path_posterior"]
    assert (None, None) in got


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "s", "en", "y"), (None, "a b", "s", "en", "z"), (2, "!!! ###", "s", "en", "y")], "doc_id long, text string, source string, lang string, evidence string").withColumn("a.b `c`", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert empirical_bayes.score(docs, none).where("kept").count() == 4
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert empirical_bayes.score(docs, some).count() == 4
    kept = empirical_bayes.kept_documents(docs, some)
    assert kept.columns == docs.columns and None in [r["doc_id"] for r in kept.collect()]
    assert empirical_bayes.score(docs.limit(0), some).count() == 0
    assert empirical_bayes.score(docs.withColumn("text", F.repeat(F.lit("a word "), 400_000)), some).count() == 4
