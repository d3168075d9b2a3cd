import hashlib

import numpy as np
import pytest

from tactigrid.llm import exact_dedup
from tactigrid.llm.exact_dedup import DedupParams, PerfectHash

SMALL = DedupParams(shard_digests=7, common_rows=3, most_common=10)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    return sorted(out, key=repr)


def run(df, params):
    return sorted((tuple(r) for r in exact_dedup.exact_duplicates(df, params).collect()), key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, slot int").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_hash_is_minimal_and_perfect(n):
    digests = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    found = PerfectHash.of(digests, DedupParams())
    assert sorted(found.slots(digests).tolist()) == list(range(n))
    others = found.slots(np.random.default_rng(7).integers(0, 256, (500, 32), dtype=np.uint8))
    assert ((others >= -1) & (others < max(n, 1))).all()


def test_hash_gives_up_on_equal_digests():
    with pytest.raises(RuntimeError):
        PerfectHash.of(np.zeros((2, 32), np.uint8), DedupParams())


def test_equals_brute_force_with_hot_text_nulls_repeats_and_long_texts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"text {rng.integers(0, 60)}") for i in range(300)] + [(1000 + i, "hot") for i in range(200)]
    rows += [(-5, None), (2000, ""), (2001, None), (None, "text 1"), (None, "nowhere else"), (None, "nowhere else"), (7, "text 7"), (7, "text 7"), (2500, "a" * 300_000), (3, "a" * 300_000), (4, "a" * 299_999 + "b"), (5, "É"), (6, "É"), (8, " hot"), (9, "Hot")]
    for params in (SMALL, DedupParams()):
        assert run(docs(spark, rows), params) == brute(rows)


def test_empty_and_single(spark):
    assert run(docs(spark, []), SMALL) == []
    for rows in ([(3, "a")], [(None, None)], [(None, "a"), (None, "a")], [(2**63 - 1, "a"), (-(2**63), "a")]):
        assert run(docs(spark, rows), SMALL) == brute(rows)


def test_arrivals_against_history(spark):
    history = [(10, "a"), (11, "a"), (12, "b"), (13, None)]
    arrivals = [(1, "a"), (20, "b"), (21, "b"), (2, "c"), (3, "c"), (4, "")]
    index = exact_dedup.build_index(exact_dedup.digests(docs(spark, history)), SMALL)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.against_history(docs(spark, arrivals), index, SMALL).collect()}
    assert got == {1: (11, 3, False), 20: (21, 3, False), 21: (21, 3, True), 2: (3, 2, False), 3: (3, 2, True), 4: (13, 2, False)}
    empty = exact_dedup.build_index(exact_dedup.digests(docs(spark, [])), SMALL)
    assert {r["doc_id"] for r in exact_dedup.against_history(docs(spark, arrivals), empty, SMALL).collect() if r["kept"]} == {1, 21, 3, 4}


def test_slots_are_compared_byte_by_byte(spark):
    index = exact_dedup.build_index(exact_dedup.digests(docs(spark, [(i, str(i)) for i in range(50)])), SMALL)
    strangers = exact_dedup.look_up(exact_dedup.digests(docs(spark, [(i, f"other {i}") for i in range(500)])), index, SMALL)
    assert strangers.where("slot is not null").isEmpty() and strangers.count() == 500
    seen = exact_dedup.look_up(exact_dedup.digests(docs(spark, [(i + 100, str(i)) for i in range(50)])), index, SMALL)
    assert seen.select("slot").distinct().count() == 50 and seen.where("winner != doc_id - 100 or n != 1").isEmpty()


def test_a_hot_shard_is_dealt_to_copies(spark):
    index = exact_dedup.build_index(exact_dedup.digests(docs(spark, [(i, str(i)) for i in range(60)])), SMALL)
    arrivals = exact_dedup.digests(docs(spark, [(i, "5") for i in range(900)] + [(i, str(i)) for i in range(60)]))
    plan = exact_dedup.look_up(arrivals, index, SMALL)
    assert plan.count() == 960 and plan.where("slot is null").isEmpty()
    assert plan.groupBy("slot").count().where("count > 1").count() == 1


def test_kept_documents_carry_their_columns(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "z")]
    kept = exact_dedup.kept_documents(docs(spark, rows), SMALL)
    assert kept.columns == ["doc_id", "text", "digest", "slot"]
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(2, "a", "x", 1), (4, "", "x", 1), (None, "z", "x", 1)], key=repr)
