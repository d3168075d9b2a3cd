import itertools

import numpy as np
import pytest

from tactigrid.llm import minhash
from tactigrid.llm.graph import components


def brute(rows, percent=85, width=5):
    """doc_id -> (shingles, component) by all pairs."""
    sets = {}
    for i, t in rows:
        w = [bytes(x) for x in (t or "").encode().lower().split()]
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, s) for i, each in sets.items() for s in each if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in sets}, sets


def words(rng, n):
    return [f"w{rng.integers(5000)}" for _ in range(n)]


def corpus():
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for _ in range(25):
        base = words(rng, int(rng.integers(6, 300)))
        for k in range(int(rng.integers(1, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(1, len(copy) // 40) + 1)) if k else 0):
                copy[int(rng.integers(len(copy)))] = f"x{rng.integers(10**6)}"
            rows.append((i, " ".join(copy)))
            i += 1
    chain = words(rng, 200)  # each like the one before, the ends unlike
    for k in range(12):
        chain[k * 15 : k * 15 + 4] = words(rng, 4)
        rows.append((i, " ".join(chain)))
        i += 1
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three four five"), (1006, "x " * 3), (1007, "x x x x x x x"), (1008, " ".join(words(rng, 9000)))]
    rows.append((1009, rows[-1][1] + " end"))
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    want, sets = brute(rows)
    got = minhash.near_duplicates(spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, bucket string, root double")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s[0]) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sum(i != c for i, c in want.items()) > 20


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text), (9, "q w e r t y")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (-1, None, True), (9, 9, True)], key=str)
    assert sorted((r["doc_id"] or -1) for r in minhash.kept_documents(df).collect()) == [-1, 5, 5, 9]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_similarity(spark):
    params, hashes = minhash.MinHashParams(), minhash.WordHashes()
    rng = np.random.default_rng(1)
    base = words(rng, 800)
    other = base[:700] + words(rng, 100)
    sets = [minhash.shingle_set(" ".join(x).encode(), hashes, 5) for x in (base, other)]
    packed = minhash.signatures(minhash.minima(sets, params), params)
    row = spark.createDataFrame([tuple(int(v) for v in np.concatenate(packed))], ", ".join(f"{k}_s{i} long" for k in "ab" for i in range(params.words)))
    real = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert row.select(minhash.estimate("a_", "b_", params).alias("e")).first()["e"] == pytest.approx(real, abs=0.1)


def test_links_of_unlucky_signatures_are_kept(spark):
    """Pairs of similarity 0.85 exactly whose estimate lies over three standard errors below."""
    params, hashes = minhash.MinHashParams(), minhash.WordHashes()
    rows = []
    for k in range(2500):
        base = [f"p{k}w{i}" for i in range(152)]
        pair = [" ".join(base), " ".join(base[:140] + [f"p{k}x{i}" for i in range(12)])]
        a, b = minhash._mixed(minhash.minima([minhash.shingle_set(t.encode(), hashes, 5) for t in pair], params)) & np.uint64(15)
        if ((a == b).mean() - 1 / 16) / (1 - 1 / 16) < 0.778:
            rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
    assert rows
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_links_inside_a_template_are_found_without_leaders(spark):
    """Texts over one template share buckets and aren't linked, but for some pairs; no leader meets these."""
    rng, rows = np.random.default_rng(6), []
    template = words(rng, 210)
    for i in range(120):
        own = [f"d{i}w{k}" for k in range(90)]
        rows.append((i, " ".join(template + own)))
        if i % 30 == 0:
            rows.append((1000 + i, " ".join(template + own[:84] + [f"e{k}" for k in range(6)])))
    want, _ = brute(rows)
    assert sum(i != c for i, c in want.items()) == 4
    for rounds in (1, 3):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.MinHashParams(leader_rounds=rounds)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_pairs_that_own_shingles_rule_out_are_never_made(spark, monkeypatch):
    """Near copies of one template (similarity about 0.8) aren't listed pair by pair; an id of two texts is judged by each of them."""
    rng, rows = np.random.default_rng(8), []
    template = words(rng, 240)
    for i in range(100):
        rows.append((i, " ".join(template + [f"d{i}w{k}" for k in range(28)])))
    rows += [(500, rows[3][1] + " end"), (600, rows[4][1] + " end"), (600, "quite another text of its own that no document has " + " ".join(words(rng, 300)))]
    want, _ = brute(rows)
    assert sum(i != c for i, c in want.items()) == 2
    made, confirmed = [], minhash.confirmed

    def counted(pairs, *rest):
        made.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(minhash, "confirmed", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.MinHashParams(leader_rounds=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert made[-1] < 500, made


def test_graph_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
