import hashlib
import math

import numpy as np
import pytest

from tactigrid.llm import lloyd


def brute(rows, k=8, rounds=10):
    def whole(x):
        return max(-(2**27), min(2**27, math.floor(1024 * x)))

    used = [(i, [whole(float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(used, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds if centroids else 0):
        members = {}
        for _, v in used:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centroids)]
    told = [(i, *nearest(v)[::-1]) for i, v in used]
    out = []
    for i, n, d in told:
        out.append((i, n, d, sum(x[2] for x in told if x[1] == n), sum(x[2] for x in told), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **params):
    df = spark.createDataFrame([(i, v, 3, "z") for i, v in rows], "vec_id long, embedding array<float>, cluster int, q string").repartition(3)
    return sorted((tuple(r) for r in lloyd.cluster(df, lloyd.LloydParams(**params)).collect()), key=repr)


@pytest.mark.parametrize("block", [4096, 9])
def test_equals_exact_arithmetic(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) * 0.2 + (i % 3)]) for i in range(120)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (5, rows[5][1])]  # ties and repeats
    assert run(spark, rows, block_rows=block) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    fine = [float(np.float32(x)) for x in rng.normal(size=64)]
    rows = [(0, fine), (1, None), (2, [*fine[:63], None]), (3, [*fine[:63], float("nan")]), (4, [*fine[:63], float("inf")]), (5, fine[:63]), (6, [*fine, 1.0]), (None, [x + 1 for x in fine]), (2**62 + 1, [-x for x in fine]), (7, [3e38, -3e38] + [0.0] * 62), (8, []), (9, fine)]
    got = run(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == {0, None, 2**62 + 1, 7, 9}
    assert run(spark, []) == [] and run(spark, rows[1:3]) == []


def test_centroids_are_floors_and_empty_ones_stay(spark):
    rows = [(i, [-0.001 * (1 + i % 2)] + [0.0] * 63) for i in range(40)]  # few distinct vectors: most centroids are empty
    got = run(spark, rows)
    assert got == brute(rows) and len({r[1] for r in got}) <= 2


def test_ties_take_the_lowest_number():
    cluster, distance = lloyd.nearest(np.array([[0, 0], [2, 0]]), np.array([[1, 0], [-1, 0], [1, 0]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [1, 1]
