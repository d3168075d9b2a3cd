import corpus_pipeline

from tactigrid.llm import minhash, mixing
from tests.llm.test_minhash import brute


def test_stages_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, folder).cache()
        assert after.columns == docs.columns
        left = {r["doc_id"]: r["text"] for r in after.collect()}
        assert left.items() <= before.items() and len(left) > 0.5 * len(before), name
        if name == "near_dedup":
            roots, _ = brute(list(before.items()))
            assert left.keys() == {i for i, r in roots.items() if i == r}
        docs, before = after, left
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    mixed = corpus_pipeline.mix(spark, docs, folder).cache()
    assert mixed.columns == docs.columns and {r["doc_id"]: len(r["text"].split()) for r in mixed.collect()} == {i: n for i, n in taken.items() if n}
    packed = corpus_pipeline.pack(spark, mixed, folder)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, n in taken.items() if n}


def test_run_names_every_document_that_is_left(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 50
    assert minhash.MinHashParams().percent == 85


def written(spark, folder, rows, columns):
    docs = spark.createDataFrame(rows, columns)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_nulls_ties_repeats_and_clashing_names_through_all_stages(spark, tmp_path):
    good = [" ".join(f"the w{k}x{i} of t{i}y{k} and" for k in range(30)) + "." for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "kept", i) for i, t in enumerate(good)]
    rows += [(100, good[0], "en", "s0", 1, "a", 1), (3, good[3], "en", "s0", 1, "a", 1), (None, good[4] + " more", None, None, 1, None, None), (101, None, None, None, None, None, None), (102, "", "en", "s1", 0, "", 0), (103, "short text", "en", "s1", 10, "", 0), (104, (good[5] + " ") * 3_000, "en", "s2", 1, "", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string, `root.x` int"
    written(spark, str(tmp_path), rows, columns)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = after.cache()
        ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in docs.collect())
        if name == "quality_rules":
            assert ids == [-1, *range(4), 3, *range(4, 12), 100]
        if name == "near_dedup":
            assert ids == [-1, *range(4), 3, *range(4, 12)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}
    assert all(r["offset"] + r["length"] <= 4096 for r in got)


def test_empty_tables_give_no_rows(spark, tmp_path):
    written(spark, str(tmp_path), [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
