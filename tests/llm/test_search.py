import math

import numpy as np
import pytest

from tactigrid.llm import impact_search


def brute(rows, every=50, k=5):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **params):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, group int")
    return sorted(tuple(r) for r in impact_search.top_k(df, impact_search.SearchParams(**params)).collect())


@pytest.mark.parametrize("block", [4096, 37])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) * 0.2]) for i in range(400)]
    rows[60] = (60, rows[0][1])  # ties and copies
    rows[61] = (61, rows[0][1])
    rows += [(450, [0.0] * 16), (451, [-1.0] * 16)]
    assert run(spark, rows, block_rows=block, query_rows=3) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [2.0]), (50, [-1.0, 0.5]), (6, [1e6, -1e6])]
    assert run(spark, rows) == brute(rows)
    huge = run(spark, [(0, [3e38, 1.0]), (1, [3e38, -3e38]), (2, [-3e38, 0.0])])
    assert [(r[2], r[3]) for r in huge] == [(1, 2**63 - 1), (2, -(2**63))]
    assert run(spark, rows[:1]) == [] and run(spark, []) == []


def test_stops_only_on_proof():
    rng = np.random.default_rng(3)
    values, queries = rng.integers(-200, 200, (500, 8)).astype(float), rng.integers(-200, 200, (7, 8)).astype(float)
    values[40:80] = values[40]
    queries[3] = 0
    ids = np.arange(500)
    for spare, levels in ((0, 32), (32, 32), (0, 3)):
        params = impact_search.SearchParams(spare=spare, levels=levels)
        got, read = impact_search.block_top(values, impact_search.Postings.of(values, levels), ids, queries, np.arange(7), np.full(7, -np.inf), params)
        assert 0 < read < 7 * values.size
        for i, found in enumerate(got):
            scores = values @ queries[i]
            want = sorted((-s, j) for j, s in enumerate(scores) if j != i)[:5]
            assert found == [(-s, j) for s, j in want]


def test_segments_hold_every_posting_once_in_order():
    rng = np.random.default_rng(4)
    values = np.column_stack([rng.integers(-9, 9, 300), np.zeros(300), rng.integers(-(2**40), 2**40, 300)]).astype(float)
    index = impact_search.Postings.of(values, 32)
    for d in range(3):
        assert sorted(index.rows[d].tolist()) == list(range(300)) and (np.diff(index.values[d]) >= 0).all()
        assert (values[index.rows[d], d] == index.values[d]).all()
        assert index.begins[d, 0] == 0 and index.begins[d, -1] == 300 and (np.diff(index.begins[d]) >= 0).all()


def test_sparse_rows_read_few_postings():
    """Where impacts are skewed, most postings are never read."""
    rng = np.random.default_rng(5)
    values = np.where(rng.random((4000, 64)) < 0.05, rng.integers(50, 255, (4000, 64)), rng.integers(0, 3, (4000, 64))).astype(float)
    queries = np.where(rng.random((20, 64)) < 0.1, rng.integers(50, 255, (20, 64)), 0).astype(float)
    params = impact_search.SearchParams()
    got, read = impact_search.block_top(values, impact_search.Postings.of(values, 32), np.arange(4000), queries, np.full(20, -1), np.full(20, -np.inf), params)
    assert read < 0.5 * (queries != 0).sum() * 4000
    for found, q in zip(got, queries, strict=True):
        assert found == [(-s, j) for s, j in sorted((-s, j) for j, s in enumerate(values @ q))[:5]]
