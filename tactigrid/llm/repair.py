"""Repair of the structure of conversations: the cheapest edits after which roles follow `(s?(ua)+)?`.

A conversation's rows in order have one fault at most (blank, duplicate or truncated) and a role initial. Edits are Keep (0),
Rerole to the role that the pattern wants (3), Delete (4; what blank and duplicate rows need) and Insert of an empty
turn of the wanted role (3); a truncated row that isn't deleted adds 3. After each prefix the pattern is in one of four states
(nothing yet, after s, after u, after a), and each edit's letter leads from a state to exactly one other, so an audit (the letters in
order) fixes the repaired turns.

1. Rows are damaged as asked and put in order once: dealt by range of conversation and turn, numbered, written. A
   conversation of any size lies in as many ranges as it needs. The first of equal (role, text) is an aggregate; its number
   marks it in a join by unique numbers. Each row becomes one letter, each run of up to 4096 letters a row, each conversation
   the string of its runs: a byte a turn, as long as the audit that the result holds of it anyway.
2. `solve` takes the conversations of an Arrow batch in buckets of like length. Time is the first axis of the tensors: at a turn, the
   costs-to-go of all conversations of a bucket and all four states are updated by one vectorised step, from the last turn
   to the first, and stored. Then all conversations are traced from the front, taking the least letter in ASCII whose cost
   and cost-to-go make up the state's, also a turn at a time. A conversation longer than `block` turns is cut into blocks that
   stand beside each other in the tensor, once for every state that they may end in, so that its steps don't follow its length;
   blocks are joined by their 4 x 4 costs, and traced side by side again, once for every state that they may begin in.
3. An audit travels ahead of its conversation's rows, sorted by number, through a task that applies the edits turn by turn. What comes out are the
   repaired turns (`repaired_turns`) or their hash (`audits`). A SHA-256 can't be taken in parts, so each conversation is a stream
   through one task, of which nothing is held but the hash.

Defined results: null conversation ids are one conversation; other nulls (role, text) are one space, and a null turn is a space
in the damage's key, comes first, and is ignored by gaps; rows of one turn come by the first 64 characters of role, then of text, then by a hash of both; a role without a first character
has no initial, like any other than s, u and a; repeated rows are duplicates of the first; a conversation all of whose rows
are dropped gives zeros, an empty audit and the hash of the empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tactigrid.llm.common import checkpointed, python_ready

#: Costs of the edits, beside Keep; what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_BLANKS = " \t\n\x0b\x0c\r"
#: More than any repair costs; sums of two fit 64 bits.
_NEVER = 1 << 60
#: After nothing, after s, after u, after a: the state that the wanted user or assistant turn leads to (Insert, Rerole).
_WANTED = np.array([2, 2, 3, 2])
#: And where keeping a row with the initial s, u, a or another leads; -1 where that isn't allowed.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_ACCEPTED = np.array([0, _NEVER, _NEVER, 0])
#: A row's letter: initial (s, u, a, other) plus four times its kind (sound, truncated, to be deleted).
_LETTERS = "abcdefghijkl"
_LEGAL = np.array([[False, True, False, False], [False, False, True, False], [False, True, False, False], [False] * 4])


@dataclass(frozen=True)
class RepairParams:
    #: Conversations of up to so many turns are one row of the tensor, longer ones as many as they need.
    block: int = 4096
    #: Turns of a tensor at most (all its rows together), unless one conversation has more.
    tensor: int = 1 << 18


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows dropped, emptied, cut, repeated or given another role by the CRC of `conv_id:turn`."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    d = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the others, with `at`: rising in the order of conversations and turns; in one run within a range."""
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.left("role", F.lit(64)), F.left("text", F.lit(64)), F.xxhash64("role", "text")]  # short: the bounds of ranges are sampled
    spread = rows.withColumn("source__", F.monotonically_increasing_id())  # equal rows may be any number
    return checkpointed(spread.repartitionByRange(*keys, "source__").sortWithinPartitions(*keys).drop("source__").withColumn("at", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """at, fault ('' if none), initial (0 to 3) of the rows that aren't gone."""
    end = F.right(F.rtrim(F.col("text"), F.lit(_BLANKS)), F.lit(1))
    there = rows.where("not gone").select("conv_id", "at", "role", "text", end.alias("end"))
    both = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    firsts = there.where("end != ''").groupBy("conv_id", F.unhex(F.sha2(both.cast("binary"), 256)).alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("end") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.coalesce(*(F.when(F.col("role").startswith(c), k) for k, c in enumerate("sua")), F.lit(3))
    return there.select("at", "conv_id", "end", initial.alias("initial")).join(firsts, "at", "left").select("at", "conv_id", fault.alias("fault"), "initial")


def measured(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, letters (a row each, in order) of every conversation."""
    kept = F.when(~F.col("gone"), F.col("turn"))
    least, most = (f(kept).cast("decimal(20,0)") for f in (F.min, F.max))
    whole = F.least(most - least + 1 - F.count_distinct(kept), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    gaps = rows.groupBy("conv_id").agg(F.when(least.isNotNull(), whole).otherwise(0).cast("long").alias("gaps"))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    letter = F.substring(F.lit(_LETTERS), 4 * kind + F.col("initial") + 1, F.lit(1))
    counts = {k: F.count_if(F.col("fault") == k) for k in ("blank", "duplicate", "truncated")}
    joined = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "letters"))), lambda x: x["letters"]), "").alias("letters")
    runs = faults(rows).withColumn("letters", letter).groupBy("conv_id", F.shiftright("at", 12).alias("run")).agg(joined("at"), *(v.alias(k) for k, v in counts.items()))
    each = runs.groupBy("conv_id").agg(joined("run"), *(F.sum(k).alias(k) for k in counts)).withColumnRenamed("conv_id", "conv__")
    none = {k: F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in counts}
    return gaps.join(each, F.col("conv_id").eqNullSafe(F.col("conv__")), "left").select("conv_id", "gaps", *none.values(), F.coalesce("letters", F.lit("")).alias("letters"))


def _tensor(codes: list[np.ndarray]) -> np.ndarray:
    """Time first; -1 after the end of what is shorter."""
    out = np.full((max(map(len, codes)), len(codes)), -1, np.int8)
    for k, c in enumerate(codes):
        out[: len(c), k] = c
    return out


def _edits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one turn of every conversation and every state: what Rerole and Keep cost, and the state that Keep leads to."""
    kind, initial = codes >> 2, codes & 3
    extra = np.where(kind == 2, _NEVER, np.where(kind == 1, TRUNCATED, 0))
    to = _KEPT[:, initial].T
    return REROLE + extra, np.where(to < 0, _NEVER, extra[:, None]), to


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs-to-go (..., state) before inserts, to those with up to two, beyond which a state would return."""
    for _ in range(2):
        costs = np.minimum(costs, costs[..., _WANTED] + INSERT)
    return costs


def costs_to_go(codes: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """From the last turn to the first: (conversations, states), the least cost of the edits from that turn on. last: of what follows all."""
    after = _inserted(last)
    yield after
    for now in codes[::-1]:
        rerole, keep, to = _edits(now)
        best = np.minimum(after + DELETE, np.minimum(after[:, _WANTED] + rerole[:, None], np.take_along_axis(after, np.maximum(to, 0), 1) + keep))
        after = np.where((now < 0)[:, None], after, np.minimum(_inserted(best), _NEVER))
        yield after


def trace(codes: np.ndarray, last: np.ndarray, state: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The least cheapest audit of every conversation from its state, and the states that they end in."""
    costs = np.empty((len(codes) + 1, *last.shape), np.int64)
    for t, now in zip(range(len(codes), -1, -1), costs_to_go(codes, last), strict=True):
        costs[t] = now
    every, letters = np.arange(codes.shape[1]), np.full((3 * len(codes) + 2, codes.shape[1]), ord(" "), np.uint8)
    for t in range(len(codes) + 1):
        here = codes[t] >= 0 if t < len(codes) else np.ones(len(every), bool)
        sooner = costs[t + 1] + DELETE if t < len(codes) else last  # what is taken before an insert, if it is as cheap
        for k in range(2):
            now, to = costs[t, every, state], _WANTED[state]
            insert = here & (sooner[every, state] != now) & (costs[t, every, to] + INSERT == now)
            letters[3 * t + k, insert] = ord("I")
            state = np.where(insert, to, state)
        if t == len(codes):
            break
        now, after, new = costs[t, every, state], costs[t + 1], state
        rerole, keep, to = _edits(codes[t])
        kept, wanted = to[every, state], _WANTED[state]
        for letter, cost, where in (("D", after[every, state] + DELETE, state), ("K", after[every, kept] + keep[every, state], kept), ("R", after[every, wanted] + rerole, wanted)):
            hit = here & (cost == now)
            letters[3 * t + 2, hit] = ord(letter)
            new, here = np.where(hit, where, new), here & ~hit
        state = new
    return [row.tobytes().replace(b" ", b"").decode() for row in np.ascontiguousarray(letters.T)], state


def _solve_long(codes: np.ndarray, params: RepairParams) -> tuple[int, str]:
    """Cost and audit of one conversation, in blocks."""
    blocks = [codes[k : k + params.block] for k in range(0, len(codes), params.block)]
    several = max(1, params.tensor // (4 * params.block))
    groups = [range(k, min(k + several, len(blocks))) for k in range(0, len(blocks), several)]
    into = []  # of every block: costs from each state to each state
    for group in groups:
        ends = np.where(np.eye(4, dtype=bool), 0, _NEVER)
        *_, first = costs_to_go(_tensor([blocks[k] for k in group for _ in range(4)]), np.tile(ends, (len(group), 1)))
        into += list(first.reshape(len(group), 4, 4).transpose(0, 2, 1))
    after = [_ACCEPTED]
    for costs in into[::-1]:
        after.append(np.minimum((costs + after[-1]).min(1), _NEVER))
    after.reverse()
    audit, state = [], 0
    for group in groups:
        texts, ends = trace(_tensor([blocks[k] for k in group for _ in range(4)]), np.repeat([after[k + 1] for k in group], 4, 0), np.tile(np.arange(4), len(group)))
        for k in range(len(group)):
            audit.append(texts[4 * k + state])
            state = ends[4 * k + state]
    return int(after[0][0]), "".join(audit)


def solve(letters: list[str], params: RepairParams = RepairParams()) -> list[tuple[int, int, str]]:
    """Of conversations as strings of letters: illegal neighbours, cost and audit."""
    codes = [np.frombuffer(x.encode(), np.int8) - np.int8(ord("a")) for x in letters]
    out: list[tuple[int, str]] = [(0, "")] * len(codes)
    buckets: dict[int, list[int]] = {}
    for k, c in enumerate(codes):
        if len(c) > params.block:
            out[k] = _solve_long(c, params)
        elif len(c):
            buckets.setdefault(len(c).bit_length(), []).append(k)
    for size, bucket in buckets.items():
        several = max(1, params.tensor >> size)
        for k in range(0, len(bucket), several):
            some = bucket[k : k + several]
            tensor, last = _tensor([codes[i] for i in some]), np.tile(_ACCEPTED, (len(some), 1))
            *_, first = costs_to_go(tensor, last)
            texts, _ = trace(tensor, last, np.zeros(len(some), np.int64))
            for i, cost, text in zip(some, first[:, 0].tolist(), texts, strict=True):
                out[i] = (cost, text)
    illegal = [int((~_LEGAL[c[:-1] & 3, c[1:] & 3]).sum()) for c in codes]
    return [(n, *x) for n, x in zip(illegal, out, strict=True)]


_ABOUT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _with_audits(found: DataFrame, params: RepairParams) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind = found.schema["conv_id"].dataType.simpleString()

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            illegal, cost, texts = zip(*solve(batch.column("letters").to_pylist(), params), strict=True) if batch.num_rows else ((), (), ())
            columns = [batch.column(c) for c in ("conv_id", *_ABOUT[:4])] + [pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *_ABOUT, "audit"])

    return found.mapInArrow(audit, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _ABOUT) + ", audit string")


def _edited(rows: DataFrame, params: RepairParams) -> DataFrame:
    """Audits (at = -1, in text, with what is known of the conversation) and rows, of a conversation in one task and in order."""
    python_ready(rows.sparkSession)
    heads = _with_audits(measured(rows), params).select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"), F.struct(*_ABOUT).alias("about"))
    both = heads.unionByName(rows.where("not gone").select("conv_id", "at", "role", "text", F.lit(None).cast(heads.schema["about"].dataType).alias("about")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at")


class _Walk:
    """The edits of one conversation, given its rows one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.place, self.state = audit, 0, 0

    def _want(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = _WANTED[self.state]
        return role

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit.startswith("I", self.place):
            self.place += 1
            yield "I", self._want(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text): inserts that come before the row, and the row."""
        yield from self.inserts()
        edit = self.audit[self.place]
        self.place += 1
        if edit == "R":
            role = self._want()
        elif edit == "K":
            self.state = _KEPT[self.state, "sua".index(role[0])]
        yield edit, role, text


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str, object]]:
    """(conversation, edit, role, text) of all edits; before each conversation (conversation, "", audit, what is known of it)."""
    walk, conv = _Walk(""), None
    for batch in batches:
        for conv_id, at, role, text, about in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text", "about")), strict=True):
            if at < 0:
                yield from ((conv, *x) for x in walk.inserts())
                walk, conv = _Walk(text), conv_id
                yield conv, "", text, about
            else:
                yield from ((conv, *x) for x in walk.row(role, text))
    yield from ((conv, *x) for x in walk.inserts())


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 500, characters: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == most or size > characters:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def repaired_turns(turns: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """All edits of turns (conv_id, turn, role, text), in order: conv_id, position (from 0), edit (K, R, I or D), role, text. What has D isn't in the repaired conversation."""
    filled = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    edited = _edited(ordered(turns.select("conv_id", "turn", *filled, F.lit(False).alias("gone"))), params)
    kind = edited.schema["conv_id"].dataType

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            position = 0
            for conv, edit, role, text in _steps(batches):
                position = position + 1 if edit else -1
                if edit:
                    yield conv, position, edit, role, text

        yield from _batches(rows(), pa.schema([("conv_id", to_arrow_type(kind)), ("position", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text"))]))

    return edited.mapInArrow(apply, f"conv_id {kind.simpleString()}, position long, edit string, role string, text string")


def audits(rows: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, gone): its measures, audit, cost and the hash of its repaired turns."""
    edited = _edited(ordered(rows), params)
    kind = edited.schema["conv_id"].dataType

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now = digest = None
            for conv, edit, role, text in _steps(batches):
                if not edit:
                    if now:
                        yield *now, digest.hexdigest()
                    now, digest, begun = (conv, *text.values(), role), hashlib.sha256(), False
                elif edit != "D":
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            if now:
                yield *now, digest.hexdigest()

        yield from _batches(found(), pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in _ABOUT), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    return edited.mapInArrow(apply, f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _ABOUT) + ", audit string, repaired_sha256 string")
