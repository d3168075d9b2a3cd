"""Mix sources to target weights.

The words of a source, document after document, are packed into blocks of a fixed length; the last one holds what is left.
The mix has slots; a shard is a run of slots. How many of a shard's slots each source gets is drawn from the multinomial of
the target weights given the totals (so that each source's total is the one that its target asks for): the tree of
halvings of all shards is walked down, with a multivariate hypergeometric draw seeded by the place in the tree at each
node, by one sampler whatever the numbers. So any shard can be made alone, again, and anywhere, and always turns out the
same. Slot j of a source takes the block that the source's pseudorandom permutation (a keyed Feistel network with cycle
walking) has at j modulo the number of blocks. Drawn blocks join the documents by source and block index. A source's last
slot takes as many words of its block as are still missing, so its target is met to the word.

Sizes: offsets of documents in their source are counted in two levels, within a task and over the tasks, so a source
with a third of all rows is never gathered. What reaches the driver is one row per source.

Defined results: null or empty texts have size 0 and are taken 0 times; null sources are one source, the last; an empty
table gives no rows; rows that repeat are documents of their own; other columns are ignored by `mix` and kept by
`mixed_documents`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed, join_small, python_ready, shielded


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5, 2, 1)
    #: The mix has so many times the words of all documents, and at most so many times those of a source.
    share: float = 1.5
    repeats: int = 2
    block_words: int = 64
    shard_slots: int = 8192
    seed: int = 17


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    #: Words that the mix takes: the target, rounded.
    words: int
    blocks: int
    slots: int
    #: Words of its block that the last slot takes.
    last: int


def _sizes(docs: DataFrame, keep_text: bool) -> DataFrame:
    """docs' columns, source_, size, part and row of the task that read it, and start: words of its source before it in that task."""
    python_ready(docs.sparkSession)
    columns = docs.columns if keep_text else ["doc_id"]
    picked = docs.select(*columns, F.col("source").cast("string").alias("source_"), F.col("text").cast("string").alias("text_"))
    schema = docs.select(*columns).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            names = batch.column("source_").to_pylist()
            sizes = [len((t or b"").split()) for t in batch.column("text_").cast(pa.binary()).to_pylist()]
            starts = []
            for name, n in zip(names, sizes, strict=True):
                starts.append(before.get(name, 0))
                before[name] = starts[-1] + n
            n = batch.num_rows
            arrays = [*(batch.column(c) for c in columns), batch.column("source_"), pa.array(sizes, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(starts, pa.int64())]
            row += n
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "source_", "size", "part", "row", "start"])

    from pyspark.sql.types import IntegerType, LongType, StringType, StructType

    out = StructType([*schema.fields]).add("source_", StringType()).add("size", LongType()).add("part", IntegerType()).add("row", LongType()).add("start", LongType())
    return picked.mapInArrow(count, out)


def targets(sizes: list[int], params: MixParams = MixParams()) -> list[float]:
    """Of sources in order: weighted shares of the whole, none above its limit, the excess shared again by weight."""
    weights = [params.weights[i % len(params.weights)] for i in range(len(sizes))]
    limits = [params.repeats * n for n in sizes]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = params.share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > limits[i]}
        for i in full or open_:
            out[i] = float(limits[i]) if full else weights[i] * unit
        if not full:
            break
        left -= sum(limits[i] for i in full)
        open_ -= full
    return out


def sources_of(totals: dict[str | None, int], params: MixParams = MixParams()) -> list[Source]:
    names = sorted((n for n in totals if n is not None)) + [None] * (None in totals)
    return [_source(i, n, totals[n], t, params) for i, (n, t) in enumerate(zip(names, targets([totals[n] for n in names], params), strict=True))]


def _source(index: int, name: str | None, size: int, target: float, params: MixParams) -> Source:
    """How many slots, in the order of the permutation, have the words of the target."""
    if not size:
        return Source(name, 0, target, 0, 0, 0, 0)
    length = params.block_words
    blocks, words = -(-size // length), round(target)
    passes, rest = divmod(words, size)
    short = blocks * length - size  # what the tail block lacks
    tail = place_of(blocks - 1, blocks, source_key(index, params))
    slots, last = 0, 0
    if rest:
        slots = -(-rest // length)
        before = (slots - 1) * length - (short if tail < slots - 1 else 0)
        if rest - before > (length - short if tail == slots - 1 else length):
            before += length - short if tail == slots - 1 else length
            slots += 1
        last = rest - before
    return Source(name, size, target, words, blocks, passes * blocks + slots, last or length)


def _seeded(*place: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(place).encode(), digest_size=16).digest(), "little"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many good ones are among `drawn` of good + bad.

    By inversion of the distribution within 12 standard deviations of its mode (what lies beyond has less than 1e-30), its
    probabilities by their ratios. Exact to the rounding of doubles for all numbers below 2^53, whatever their size.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(max((good + 1) * (drawn + 1) // (total + 2), low), high)
    reach = 64 + int(12 * (drawn / total * good * (bad / total) * ((total - drawn) / max(1, total - 1))) ** 0.5)
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    rise = np.cumsum(np.log((good - up) / (up + 1)) + np.log((drawn - up) / (bad - drawn + up + 1)))
    fall = np.cumsum(np.log(down / (good - down + 1)) + np.log((bad - drawn + down) / (drawn - down + 1)))
    sums = np.cumsum(np.exp(np.concatenate([fall[::-1], [0.0], rise])))
    return mode - len(fall) + min(int(np.searchsorted(sums, rng.random() * sums[-1], "right")), len(sums) - 1)


def _first_part(counts: np.ndarray, slots: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of `slots` of the sum(counts) shuffled slots belong to each source."""
    rng, rest, out = _seeded(*seed), int(counts.sum()), np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        rest -= n
        out[i] = hypergeometric(rng, n, rest, slots)
        slots -= int(out[i])
    return out


def shard_counts(first: int, last: int, shards: int, slots: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, sources, first slot and number of slots of each) of the shards from first up to last; sources without slots are left out."""
    total = int(slots.sum())
    bound = lambda k: k * total // shards

    def walk(low: int, high: int, own: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        if high - low == 1:
            yield low, own, begin, counts
            return
        middle = (low + high) // 2
        left = _first_part(counts, bound(middle) - bound(low), (seed, low, high))
        for a, b, begins, part in ((low, middle, begin, left), (middle, high, begin + left, counts - left)):
            if a < last and b > first:
                some = part > 0
                yield from walk(a, b, own[some], begins[some], part[some])

    own = np.flatnonzero(slots)
    yield from walk(0, shards, own, np.zeros(len(own), np.int64), slots[own].astype(np.int64))


def source_key(index: int, params: MixParams) -> int:
    return params.seed * 1_000_003 + index


def _network(size: int, key: int) -> tuple[np.uint64, np.uint64, np.ndarray]:
    """Bits and mask of a half, and the keys of the rounds."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    return np.uint64(half), np.uint64((1 << half) - 1), _seeded(key, size).integers(0, 2**63, 6).astype(np.uint64)


def _mixed(right: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) & mask


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Images of index under a pseudorandom permutation of range(size)."""
    half, mask, keys = _network(size, key)

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ _mixed(right, k, mask)
        return (left << half) | right

    x = rounds(index.astype(np.uint64))
    while (out := np.flatnonzero(x >= size)).size:
        x[out] = rounds(x[out])
    return x.astype(np.int64)


def place_of(image: int, size: int, key: int) -> int:
    """The index that `permuted` takes to image: its rounds backwards."""
    half, mask, keys = _network(size, key)
    x = np.array([image], np.uint64)
    while True:
        left, right = x >> half, x & mask
        for k in keys[::-1]:
            left, right = right ^ _mixed(left, k, mask), left
        x = (left << half) | right
        if x[0] < size:
            return int(x[0])


def drawn_blocks(spark, sources: list[Source], params: MixParams) -> DataFrame:
    """source_index, block, words (of its beginning), times: how often the mix takes each block that it takes."""
    slots = np.array([s.slots for s in sources], np.int64)
    blocks, last = [s.blocks for s in sources], [s.last for s in sources]
    shards = max(1, -(-int(slots.sum()) // params.shard_slots))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy()  # a run of shards
            for _, own, first, counts in shard_counts(int(wanted[0]), int(wanted[-1]) + 1, shards, slots, params.seed):
                made = []
                for i, begin, n in zip(own.tolist(), first.tolist(), counts.tolist(), strict=True):
                    place = np.arange(begin, begin + n)
                    words = np.where(place == slots[i] - 1, last[i], params.block_words)
                    made.append((np.full(n, i, np.int32), permuted(place % blocks[i], blocks[i], source_key(i, params)), words))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=["source_index", "block", "words"])

    made = spark.range(0, shards, 1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    return made.mapInArrow(draw, "source_index int, block long, words long").groupBy("source_index", "block", "words").agg(F.count("*").alias("times"))


def _plan(docs: DataFrame, params: MixParams, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    """Documents with their places, and one row per document and drawn block that it has words in."""
    spark = docs.sparkSession
    sized = checkpointed(_sizes(docs, keep_text))
    by_part = checkpointed(sized.groupBy("part", "source_").agg(F.sum("size").alias("n")))
    sources = sources_of({r["source_"]: r["n"] for r in by_part.groupBy("source_").agg(F.sum("n").alias("n")).collect()}, params)
    listed = spark.createDataFrame([(i, s.name, s.size, s.target) for i, s in enumerate(sources)], "source_index int, source_name string, source_size long, target double")
    earlier = Window.partitionBy("source_").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "source_", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    base = checkpointed(base.join(listed, base["source_"].eqNullSafe(listed["source_name"])).drop("source_name"))
    sized = join_small(sized.withColumn("key_", F.coalesce(F.concat(F.lit("="), "source_"), F.lit("null"))).drop("source_"), base.withColumn("key_", F.coalesce(F.concat(F.lit("="), "source_"), F.lit("null"))).drop("source_"), ["part", "key_"], "inner").drop("key_")
    placed = sized.withColumn("begin", F.col("base") + F.col("start")).drop("base", "start")
    length = params.block_words
    cut = placed.where("size > 0").select("part", "row", "source_index", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {length}"), F.expr(f"(begin + size - 1) div {length}"))).alias("block"))
    # Spark guesses the drawn blocks from the few rows of the shards that make them and would broadcast them; they grow with the input.
    used = cut.join(drawn_blocks(spark, sources, params).hint("merge"), ["source_index", "block"]).select(
        "part",
        "row",
        "times",
        F.greatest(F.col("block") * length - F.col("begin"), F.lit(0)).alias("from_word"),
        F.least(F.col("block") * length + F.col("words") - F.col("begin"), F.col("size")).alias("to_word"),
    )
    return placed, used.where("to_word > from_word")


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken."""
    placed, used = _plan(docs, params, False)
    taken = used.groupBy("part", "row").agg(F.sum(F.col("times") * (F.col("to_word") - F.col("from_word"))).alias("taken"))
    return placed.join(taken, ["part", "row"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def cut_text(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The words [from, to) of every run with the white space between them, in text order; once more, after a line end, what is taken again."""
    ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    taken = np.zeros(len(ends) + 1, np.int64)
    for low, high, times in runs:
        taken[low] += times
        taken[high] -= times
    taken = np.cumsum(taken)
    out = []
    for turn in range(int(taken.max())):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (taken > turn).astype(np.int8)]))).tolist()
        if edges == [0, len(ends)]:
            out.append(text)
        else:
            out += [text[ends[low][0] : ends[high - 1][1]] for low, high in zip(edges[::2], edges[1::2], strict=True)]
    return "\n".join(out)


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The documents of which the mix takes words, with the columns of docs; text holds the words it takes, n_chars (if there) their length."""
    docs, restored = shielded(docs, ("text", "source"))
    placed, used = _plan(docs, params, True)
    runs = used.groupBy("part", "row").agg(F.collect_list(F.struct("from_word", "to_word", "times")).alias("runs_"))  # at most one per block of the document
    kept = placed.join(runs, ["part", "row"]).select(*docs.columns, "runs_")
    schema, names = docs.schema, docs.columns
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs_")
            low, high, times = (runs.values.field(k).to_numpy() for k in ("from_word", "to_word", "times"))
            ends = runs.offsets.to_pylist()
            each = (list(zip(low[a:b].tolist(), high[a:b].tolist(), times[a:b].tolist(), strict=True)) for a, b in zip(ends, ends[1:], strict=False))
            texts = [cut_text(t.as_py(), own) for t, own in zip(batch.column("text"), each, strict=True)]
            columns = [batch.column(c) for c in names]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    mixed = kept.mapInArrow(cut, schema).select(*restored)
    return mixed.withColumn("n_chars", F.length("text").cast(mixed.schema["n_chars"].dataType)) if "n_chars" in mixed.columns else mixed
