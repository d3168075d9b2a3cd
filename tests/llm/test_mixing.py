import math

import numpy as np
import pytest

from tactigrid.llm import mixing


def test_targets_stop_at_twice_the_size():
    assert mixing.targets([100, 100, 100]) == [200.0, 166.66666666666666, 83.33333333333333]
    t = mixing.targets([10, 1000, 5, 0])
    assert t[0] == 20 and t[3] == 0 and sum(t) == pytest.approx(1.5 * 1015)
    assert mixing.targets([]) == []


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_permutations(size):
    assert sorted(mixing.permuted(np.arange(size), size, 5).tolist()) == list(range(size))


def test_permutations_backwards():
    for size in (1, 2, 3, 17, 1000):
        images = mixing.permuted(np.arange(size), size, 5)
        assert [mixing.place_of(int(x), size, 5) for x in images] == list(range(size))


def shards_of(low, high, shards, slots, seed):
    out = {}
    for shard, own, first, counts in mixing.shard_counts(low, high, shards, slots, seed):
        out[shard] = ({int(i): (int(f), int(n)) for i, f, n in zip(own, first, counts, strict=True)})
    return out


def test_shards_add_up_and_are_the_same_again():
    slots = np.array([50, 3, 0, 947])
    parts = shards_of(0, 7, 7, slots, 17)
    assert sorted(parts) == list(range(7))
    at = {0: 0, 1: 0, 3: 0}
    for k in range(7):
        for i, (first, n) in parts[k].items():
            assert first == at[i] and n > 0
            at[i] += n
    assert at == {0: 50, 1: 3, 3: 947}
    assert shards_of(4, 5, 7, slots, 17) == {4: parts[4]} and shards_of(2, 6, 7, slots, 17) == {k: parts[k] for k in range(2, 6)}
    assert abs(sum(n for _, n in parts[0].values()) - 1000 / 7) < 1


@pytest.mark.parametrize("total", [499_999_000, 500_001_000, 10**13])
def test_large_draws_spread_as_small_ones(total):
    """Of 800 draws, mean and standard deviation are those of the distribution, whatever the population."""
    if total == 10**13:
        draws = [mixing.hypergeometric(np.random.default_rng(k), 3 * 10**12, total - 3 * 10**12, 10**6) for k in range(200)]
        n, good = 10**6, 3 * 10**12
    else:
        n, good = total // 2, total // 3
        draws = [mixing.hypergeometric(np.random.default_rng(k), good, total - good, n) for k in range(200)]
    p = good / total
    sd = (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5
    assert abs(np.mean(draws) - n * p) < 5 * sd / 200**0.5
    assert abs(np.std(draws) / sd - 1) < 0.2


def test_small_draws_have_the_right_frequencies():
    rng, want = np.random.default_rng(1), [math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5) for k in range(6)]
    seen = np.bincount([mixing.hypergeometric(rng, 6, 9, 5) for _ in range(4000)], minlength=6) / 4000
    assert np.abs(seen - want).max() < 0.03
    assert mixing.hypergeometric(rng, 5, 0, 3) == 3 and mixing.hypergeometric(rng, 0, 5, 3) == 0 and mixing.hypergeometric(rng, 2, 3, 5) == 2


def test_drawn_blocks_against_every_slot_by_hand(spark):
    """The joined blocks are those that walking slot by slot through all permutations takes."""
    params = mixing.MixParams(block_words=8, shard_slots=16)
    sources = mixing.sources_of({"a": 1001, "b": 77, "c": 5, None: 0, "d": 640}, params)
    want = {}
    for i, s in enumerate(sources):
        words = 0
        for j in range(s.slots):
            block = int(mixing.permuted(np.array([j % s.blocks]), s.blocks, mixing.source_key(i, params))[0])
            taken = s.last if j == s.slots - 1 else 8
            want[(i, block, taken)] = want.get((i, block, taken), 0) + 1
            words += min(taken, s.size - 8 * block)
        assert words == s.words == round(s.target)
    got = {(r["source_index"], r["block"], r["words"]): r["times"] for r in mixing.drawn_blocks(spark, sources, params).collect()}
    assert got == want


def rows_of(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 300))), ["b", "a", "é", "z", None][int(rng.choice(5, p=[0.5, 0.2, 0.1, 0.1, 0.1]))]) for i in range(300)]
    return [*rows, (300, None, "a"), (301, "", None), (302, "x y", "tiny"), (7, "again and again", "a"), (7, "again and again", "a"), (None, "w " * 5000, "b")]


def test_mix_against_direct_counts(spark):
    rows = rows_of(spark)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, part int, size int").repartition(5)
    got = mixing.mix(df).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in got) == sorted((i if i is not None else -1, len((t or "").split())) for i, t, _ in rows)
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + len((t or "").split())
    order = sorted(s for s in totals if s is not None) + [None]
    want = dict(zip(order, mixing.targets([totals[s] for s in order]), strict=True))
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert set(by_target) == {(totals[s], want[s]) for s in order}
    for (size, target), taken in by_target.items():
        assert sum(taken) == round(target)
    again = mixing.mix(df).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_hold_what_is_taken(spark):
    rows = [(i, "\n".join(f"d{i}w{k}" for k in range(100 + i)), "src" + str(i % 3), "k") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string").withColumn("n_chars", df_length())
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    got = {r["doc_id"]: r for r in mixed.collect()}
    assert got.keys() == {i for i, n in taken.items() if n}
    for i, r in got.items():
        assert len(r["text"].split()) == taken[i] and set(r["text"].split()) <= set(rows[i][1].split()) and r["n_chars"] == len(r["text"]) and r["row"] == "k"


def df_length():
    from pyspark.sql import functions as F

    return F.length("text").cast("long")
