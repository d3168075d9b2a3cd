import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tactigrid.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    """Pieces are those of the tokenizer, sequences are gapless and within the capacity."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for p, k in enumerate(range(0, len(ids), 4096)):
            cut = np.asarray(ids[k : k + 4096], "<u4")
            want[(doc_id, p, k, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences), sum(r["length"] for r in rows)


def test_documents_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n, total = check(packing.pack(docs, VOCABULARY).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert n <= -(-total // 4096) + 1


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "it's a TEST... <|endoftext|>x <|ENDOFTEXT|> İstanbul ΣΑΣ é don't!!?'s a b \x1c3,14 #### 日本語です。 ñandú's"), (4, "word, " * 9000), (5, "İİ é́,"), (6, "a.'s b)'t c'll.")]
    df = spark.createDataFrame([(*t, 7, 8) for t in texts], "doc_id long, text string, part int, length int")
    check(packing.pack(df, VOCABULARY).collect(), texts)
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {1: 10000}, {2048: 3, 4095: 2, 1: 1}, {1366: 6, 1364: 3}, {3000: 4, 500: 8, 96: 4}])
def test_plan_uses_every_piece_once(counts):
    plan = packing.plan_sequences(counts)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 4096 and times > 0
        for length in lengths:
            used[length] += times
    assert used == Counter(counts)
    assert sum(t for _, t in plan) <= -(-sum(k * v for k, v in counts.items()) // 4096) + 2
    table = packing.places(plan)
    assert set(table[:, 0].tolist()) == set(counts)


def test_every_letter_and_digit_before_punctuation():
    """Words are parted only where the tokenizer parts them, whatever their last character."""
    ids, tokenizer = packing.WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert ids.by_word
    some = [chr(c) for c in range(128, 0x110000) if chr(c).isalnum()]
    for tail in (".", "|", ",\""):
        words = [f"a{c}{tail}" for c in some]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        got = ids.encode([w.encode() for w in words])
        assert [w for w, a, b in zip(words, want, got, strict=True) if a != b] == []


def test_other_vocabularies_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    assert not ids.by_word
    text = "Some words,  with spaces. And\nlines"
    assert ids.encode([text.encode()]) == [np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_index_of_sums_against_all_combinations():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = {int(k): int(rng.integers(1, 5)) for k in rng.integers(1, 20, 6)}
        index = packing.SumIndex(counts, 40)
        for _ in range(8):
            k = int(rng.choice(list(counts)))
            change = int(rng.integers(-index.left[k], 3))
            index.add(k, change)
            left = Counter({n: int(index.left[n]) for n in counts})
            for size in (1, 2, 3):
                sums = Counter(sum(c) for c in itertools.combinations_with_replacement(sorted(counts), size) if all(left[n] >= m for n, m in Counter(c).items()))
                assert {s: n for s, n in enumerate(index.combinations[size].tolist()) if n} == {s: n for s, n in sums.items() if s <= 40}
            for gap in range(1, 41):
                found = index.exact(gap)
                assert bool(found) == any(index.combinations[size][gap] for size in (1, 2, 3))
                assert not found or (sum(found) == gap and all(left[n] >= m for n, m in Counter(found).items()))


def test_exact_complements_are_found():
    assert packing.plan_sequences({3000: 1, 1096: 1}) == [((3000, 1096), 1)]
    assert sorted(packing.plan_sequences({3000: 1, 600: 1, 496: 1})[0][0]) == [496, 600, 3000]
    assert sorted(packing.plan_sequences({3000: 2, 600: 2, 300: 2, 196: 2})[0][0]) == [196, 300, 600, 3000]


def test_the_older_generation_is_looked_up_and_never_gone_through():
    class Kept(dict):
        def __iter__(self):
            raise AssertionError("the whole generation was gone through")

    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = ids.encode([b"several words, and more words."])
    ids.older, ids.known = Kept(ids.known), {}
    assert ids.encode([b"several words, and more words."]) == want and ids.known
