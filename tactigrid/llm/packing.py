"""Pack token sequences of documents into as few sequences of a fixed capacity as possible.

A document's ids are cut into pieces of at most the capacity. The plan is made from the histogram of piece lengths,
which has at most `capacity` entries whatever the corpus. An index holds, for every sum, how many combinations of one, two
and three available lengths have it under the counts that are left. Going down from the longest length, the index is
looked up at a gap's exact complement, and the combination found fills the gap as often as all of its lengths last; where
no such combination is left, the residual gap takes the best fitting length again and again. Each step uses up at least
one length, so the plan has a few thousand rows at most. Every piece then gets its rank among the pieces of its length,
and the rank decides its place: ranks are dealt to plan rows in order.

Ranks are counted in two levels (within a task, then over the tasks), so that a length that a third of all pieces have
is never gathered in one task. Pieces are written to the shared checkpoint folder before they are ranked: what a
lost executor recomputes can't change them.

Defined results: null text is empty and becomes the end id alone; an empty table gives no rows; rows that repeat are
packed once each; other columns are ignored. The texts are never cut before they are tokenised.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed, python_ready

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker keeps, in two generations: when the younger has half of them, the older goes.
CACHED_WORDS = 600_000


#: Characters that end a pre-token after a letter or digit and never join the next; the apostrophe can.
_TAIL = b".,;:!?)*#$%&|>-\"]}"

# How the vocabulary whose words can be looked up one by one prepares a text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordIds:
    """Ids of words between ASCII white space, as little-endian 32-bit bytes; `known` is filled batch by batch.

    The vocabulary's pre-tokeniser drops white space and never joins across it, so ids of a text are those of its
    words in order. It also parts a letter or digit from the punctuation that follows, and ignores case: a new word's ids
    are then those of its lower-cased beginning and of its tail, which are looked up first. A beginning whose last
    character is, once normalised, no letter or digit (some decompose) isn't parted. A vocabulary that prepares texts in
    another way gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(Path(path).read_text())
        splits = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = shape.get("normalizer") == _NORMALIZER and splits[0].get("pattern") == {"Regex": _SPLIT} and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] for p in splits[1:])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.parts_after: dict[str, bool] = {}

    def _words(self, text: bytes) -> list[bytes]:
        return (text if b"<|" in text else text.lower()).split()

    def _ends_word(self, core: bytes) -> bool:
        """Whether what follows the beginning is a pre-token of its own."""
        if core[-1] < 128:
            return core[-1:].isalnum()
        last = core.decode()[-1]
        if (found := self.parts_after.get(last)) is None:
            normal = self.tokenizer.normalizer.normalize_str(last)
            found = self.parts_after[last] = all(unicodedata.category(c)[0] in "LN" for c in last + normal)
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if len(self.known) > CACHED_WORDS // 2:
            self.older, self.known = self.known, {}
        words = [self._words(t) for t in texts]
        found = [list(map(self.known.get, own)) for own in words]
        missing = [[k for k, ids in enumerate(own) if ids is None] if None in own else () for own in found]
        self._learn({own[k] for own, places in zip(words, missing, strict=True) for k in places})
        for own, ids, places in zip(words, found, missing, strict=True):
            for k in places:
                ids[k] = self.known[own[k]]
        return [b"".join(ids) for ids in found]

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        self._recall(new)
        cut, whole = [], []
        for word in new.difference(known):
            core = word.rstrip(_TAIL)
            if len(core) == len(word) or not core or b"<|" in word or not self._ends_word(core):
                whole.append(word)
            else:
                cut.append((word, core, word[len(core) :]))
        parts = {part for _, core, tail in cut for part in (core, tail)}.difference(known, whole)
        self._recall(parts)
        whole += parts.difference(known)
        self._encode(whole)
        for word, core, tail in cut:
            known[word] = known[core] + known[tail]

    def _recall(self, words: set[bytes]) -> None:
        """From the older generation, by looking the words up: an intersection with a dict would go through the whole of it."""
        older = self.older
        self.known.update([(word, older[word]) for word in words if word in older])

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters only are one pre-token each, whose last id is marked as a word end: they are encoded as one text."""
        texts = [w.decode() for w in words]
        letters = [k for k, t in enumerate(texts) if t.isalpha()]
        others = [k for k, t in enumerate(texts) if not t.isalpha()]
        for k in range(0, len(letters), 2000):
            some = letters[k : k + 2000]
            ids = np.asarray(self.tokenizer.encode(" ".join([texts[i] for i in some]), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(some):
                others += some
                continue
            data, low = ids.tobytes(), 0
            for i, high in zip(some, (4 * ends).tolist(), strict=True):
                self.known[words[i]] = data[low:high]
                low = high
        for k in range(0, len(others), 20_000):
            some = others[k : k + 20_000]
            for i, encoded in zip(some, self.tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                self.known[words[i]] = array("I", encoded.ids).tobytes()


@cache
def word_ids(path: str) -> WordIds:
    """Shared by the tasks that one worker process runs."""
    return WordIds(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and where the row was made: part and rank within part and length."""
    python_ready(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = word_ids(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                some = batch.slice(k, 250)
                encoded = ids_of.encode([t or b"" for t in some.column("text").cast(pa.binary()).to_pylist()])
                out: list[tuple] = []
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoded, strict=True):
                    data = ids + end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[at : at + 4 * capacity]
                        n = len(cut) // 4
                        out.append((doc_id, piece, at // 4, n, zlib.crc32(cut), part, int(seen[n])))
                        seen[n] += 1
                del encoded
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])
        ids_of.older = {}  # a worker that waits for its next task holds one generation only

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")


class SumIndex:
    """How many combinations of one, two and three of the pieces that are left have each sum, by lengths.

    combinations[k][s] counts the multisets of k lengths that sum to s and that the counts allow. They are the coefficients
    of a product with one factor a length, so a length whose count passes 3, 2, 1 or 0 changes them by a few shifted
    differences; nothing is ever searched for.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        self.combinations = [np.zeros(capacity + 1, np.int64) for _ in range(4)]
        self.combinations[0][0] = 1
        for length, n in counts.items():
            self.add(length, n)

    def add(self, length: int, n: int) -> None:
        before, self.left[length] = min(3, int(self.left[length])), self.left[length] + n
        after = min(3, int(self.left[length]))
        if before == after:
            return
        for sign, level in ((-1, before), (1, after)):
            made = [self.combinations[0]]
            for k in (1, 2, 3):  # divide by the old factor, multiply by the new one
                own = self.combinations[k].copy()
                for use in range(1, min(k, level) + 1):
                    if use * length < len(own):
                        own[use * length :] += sign * (made if sign < 0 else self.combinations)[k - use][: len(own) - use * length]
                made.append(own)
            self.combinations = made

    def single(self, total: int) -> tuple[int, ...]:
        return (total,) if self.combinations[1][total] else ()

    def pair(self, total: int) -> tuple[int, ...]:
        """The pair with the longest length."""
        if not self.combinations[2][total]:
            return ()
        first = np.arange(total - 1, (total - 1) // 2, -1)
        found = int(np.argmax((self.left[first] > 0) & (self.left[total - first] > (first == total - first))))
        return int(first[found]), int(total - first[found])

    def triple(self, total: int) -> tuple[int, ...]:
        """The triple with the longest length: its complement is looked up among the pairs."""
        if not self.combinations[3][total]:
            return ()
        longest = np.arange(total - 2, (total - 1) // 3, -1)
        for first in longest[(self.left[longest] > 0) & (self.combinations[2][total - longest] > 0)].tolist():
            self.add(first, -1)
            rest = self.pair(total - first)
            self.add(first, 1)
            if rest:
                return first, *rest
        raise AssertionError("the index counts a triple that isn't there")

    def exact(self, gap: int) -> tuple[int, ...]:
        """A combination of up to three lengths that fills the gap; the one of fewest lengths."""
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def best(self, gap: int) -> int:
        """The longest length that fits, 0 if none does."""
        fits = np.flatnonzero(self.left[1 : gap + 1] > 0)
        return int(fits[-1]) + 1 if len(fits) else 0


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many sequences have them), using exactly the pieces that counts has."""
    index = SumIndex(counts, capacity)
    plan: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while index.left[length] > 0:
            chosen, gap = [length], capacity - length
            index.add(length, -1)
            while gap:
                rest = index.exact(gap)
                if not rest:
                    best = index.best(gap)
                    rest = (best,) if best else ()
                if not rest:
                    break
                for r in rest:
                    index.add(r, -1)
                chosen += rest
                gap -= sum(rest)
            need = np.bincount(chosen, minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = 1 + int((index.left[used] // need[used]).min())
            for r in used.tolist():
                index.add(r, -int(need[r]) * (times - 1))
            plan.append((tuple(chosen), times))
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: ranks up to the next row's go to successive sequences."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in plan:
        for length, end in zip(lengths, accumulate(lengths), strict=True):
            rows.append((length, used.get(length, 0), base, end - length))
            used[length] = used.get(length, 0) + times
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = checkpointed(pieces(docs, vocabulary, capacity, end_id))
    by_part = checkpointed(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan_sequences(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = made.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    keys = (table[:, 0] << 48) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("rank", "length"))
            row = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(table[row, 2] + rank - table[row, 1]), pa.array(table[row, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
