import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest

from tactigrid.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, letters string, at int"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def fault(rows, k):
    text = rows[k][3]
    seen = [c for c in text if c not in " \t\n\v\f\r"]
    if not seen:
        return "blank"
    if any(r[2:] == rows[k][2:] for r in rows[:k]):
        return "duplicate"
    return "" if seen[-1] in ".!?" else "truncated"


def best(rows, faults):
    """Cost, audit and repaired turns by trying all edits: prefixes of the wanted pattern, up to two inserts in each gap."""

    @cache
    def rest(k, initials, inserts):
        found = []
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", initials):
                found.append((0, "", ()))
        else:
            _, _, role, text = rows[k]
            found += [(4 + c, "D" + a, t) for c, a, t in rest(k + 1, initials, 0)]
            if faults[k] not in ("blank", "duplicate"):
                extra = 3 if faults[k] == "truncated" else 0
                for letter, cost, new in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if new[:1] and re.fullmatch("s?(ua)*u?", longer := initials + new[:1]):
                        found += [(cost + extra + c, letter + a, ((new, text), *t)) for c, a, t in rest(k + 1, shortened(longer), 0)]
        if inserts < 2:
            for new in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", longer := initials + new[0]):
                    found += [(3 + c, "I" + a, ((new, ""), *t)) for c, a, t in rest(k, shortened(longer), inserts + 1)]
        return [min(found, key=lambda x: x[:2])] if found else []

    return rest(0, "", 0)[0]


def shortened(initials):
    """The same place in the pattern, so that equal places are met once."""
    return initials if len(initials) < 4 else initials[-4:] if initials[-4] == "u" else initials[-3:]


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == c])
        faults = [fault(own, k) for k in range(len(own))]
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, left = best(tuple(own), tuple(faults))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def run(spark, rows, **params):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in repair.audits(repair.damaged(df), repair.RepairParams(**params)).collect()), key=repr)


def generated(seed, conversations, longest):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No", "Well!\n", " ", "", "So? ", "and", "Fine.", "One more.", "é.", None]
    return [(c, int(t), rng.choice(["user", "assistant", "system", "tool", "u", "Sys"], p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05]).item(), texts[rng.integers(0, len(texts))] if rng.random() < 0.4 else f"{rng.integers(0, 99)}.") for c in range(conversations) for t in range(rng.integers(1, longest))]


@pytest.mark.parametrize("params", [{}, {"block": 3, "tensor": 24}])
def test_equals_all_edits_tried(spark, params):
    rows = generated(0, 60, 12)
    assert run(spark, rows, **params) == brute(rows)


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = generated(1, 4, 6)
    rows += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (None, None, None, None), (50, None, None, "x."), (50, None, "", "y."), (50, 2**63 - 1, "user", "z"), (50, -(2**63), "user", "z")]
    rows += [(51, 1, "user", "same."), (51, 1, "user", "same."), (51, 1, "assistant", "b."), (51, 1, "assistant", "a."), (51, 2, "user", "long. " * 50_000), (52, None, "system", "only.")]
    got, want = run(spark, rows), brute(rows)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[2:] == b[2:]
        assert a[1] == min(b[1], 2**63 - 1)
    assert run(spark, []) == []


def test_a_conversation_whose_rows_are_dropped_is_returned(spark):
    gone = next(t for t in range(10_000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert run(spark, [(9, gone, "user", "a.")]) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversations_in_blocks_equal_whole_ones():
    rng = np.random.default_rng(5)
    for length in (9, 50, 1000):
        letters = ["".join(rng.choice(list("abcdefghijkl"), length)) for _ in range(5)]
        assert repair.solve(letters, repair.RepairParams(block=7, tensor=120)) == repair.solve(letters)


def test_half_of_all_rows_in_one_conversation(spark):
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(9000)] + [(c, t, "user", f"{t}.") for c in range(1, 3001) for t in range(3)]
    got = {r[0]: r for r in run(spark, rows)}
    own = damage(rows[:9000])
    assert len(got) == 3001 and len(got[0][7].replace("I", "")) == len(own)
    by_whole = run(spark, rows[:9000], block=1 << 20)
    assert by_whole == [got[0]]


def test_repaired_turns_are_the_conversation(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "b."), (1, 3, "user", " "), (2, 0, "user", "q?"), (2, 1, "assistant", "r."), (3, 0, "assistant", "alone.")]
    got = [tuple(r) for r in repair.repaired_turns(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).orderBy("conv_id", "position").collect()]
    assert got[:4] == [(1, 0, "K", "system", "s."), (1, 1, "R", "user", "a."), (1, 2, "K", "assistant", "b."), (1, 3, "D", "user", " ")]
    assert got[4:] == [(2, 0, "K", "user", "q?"), (2, 1, "K", "assistant", "r."), (3, 0, "I", "user", ""), (3, 1, "K", "assistant", "alone.")]
