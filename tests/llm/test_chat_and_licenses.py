import json
import math
import textwrap

import numpy as np
import pytest

from tactigrid.llm import chat, licenses

SCHEMA = "conv_id long, turn long, role string, text string, status string"


def formatted(spark, rows):
    return [tuple(r) for r in chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).orderBy("conv_id", "position").collect()]


def call(*calls, content="ok"):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_results_follow_their_calls_in_the_calls_order(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "search", {"query": "x"}), ("b", "weather", {"city": "y", "metric": True}))), (1, 2, "user", "wait"), (1, 3, "tool", result("b", "B")), (1, 4, "tool", result("a", "A")), (1, 5, "tool", result("a", "again")), (1, 6, "tool", result("zz", "?"))]
    got = formatted(spark, rows)
    assert [(r[1], r[2], r[4], r[5]) for r in got] == [(0, 0, "message", None), (1, 1, "calls", None), (2, 4, "result", "a"), (3, 3, "result", "b"), (4, 2, "message", None), (5, 5, "duplicate", "a"), (6, 6, "orphan", "zz")]
    assert got[1][6:9] == (2, 2, True)
    assert got[1][9] == '{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"query":"x"},"id":"a","name":"search"},{"arguments":{"city":"y","metric":true},"id":"b","name":"weather"}]}'


def test_arguments_are_validated(spark):
    cases = [({"query": "x"}, True), ({"query": 5}, False), ({}, False), ({"query": "x", "limit": 2}, True), ({"query": "x", "limit": "2"}, False), ({"query": "x", "other": 1}, False), ("query", False)]
    rows = [(i, 0, "assistant", call(("a", "search", a))) for i, (a, _) in enumerate(cases)] + [(99, 0, "assistant", call(("a", "unknown", {"query": "x"})))]
    assert [r[8] for r in formatted(spark, rows)] == [v for _, v in cases] + [False]


def test_calls_without_an_id_and_unparseable_arguments_are_kept(spark):
    good, broken = {"query": "x"}, '{"query": "x'
    rows = [
        (1, 0, "assistant", call(("a", "search", good), (None, "search", {"query": "y"}))),
        (1, 1, "tool", result("a", "A")),
        (2, 0, "assistant", call(("a", "search", broken), ("b", "search", "plain"), ("c", "search", good))),
        (3, 0, "assistant", call((None, "search", good))),
        (4, 0, "assistant", call((None, None, good))),
        (5, 0, "assistant", call(("a", "search", json.dumps(good)), ("b", "search", None))),
    ]
    got = formatted(spark, rows)
    assert [(r[0], r[4], r[6], r[7], r[8]) for r in got] == [(1, "calls", 2, 1, False), (1, "result", 0, 0, None), (2, "calls", 3, 0, False), (3, "calls", 1, 0, False), (4, "message", 0, 0, None), (5, "calls", 2, 0, False)]
    calls = {r[0]: [(x["id"], x["arguments"]) for x in json.loads(r[9])["tool_calls"]] for r in got if r[4] == "calls"}
    assert calls == {1: [("a", good), (None, {"query": "y"})], 2: [("a", broken), ("b", "plain"), ("c", good)], 3: [(None, good)], 5: [("a", good), ("b", None)]}
    assert json.loads(got[4][9])["content"] == rows[4][3]


def test_canonical_json_sorts_nested_keys(spark):
    (r,) = formatted(spark, [(1, 0, "assistant", call(("a", "search", {"z": {"b": 1, "a": [{"d": 1, "c": 2}]}, "query": "é\n"})))])
    parsed = json.loads(r[9])
    assert json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r[9]


def test_nothing_that_was_given_is_lost(spark):
    big = 12345678901234567890123456789012345678901234567890
    rows = [
        (1, 0, "assistant", json.dumps({"note": {"b": 1, "a": 2}, "content": None, "tool_calls": [{"type": "function", "id": "a", "name": "search", "arguments": {"query": "x"}}]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "name": "n", "content": {"z": [1, {"y": 2, "x": None}], "a": 1.5}})),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": json.dumps({"query": "x", "limit": big})}]})),
        (3, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "search", "arguments": "{\\"query\\": 1, \\"query\\": 2}"}]}'),
        (4, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": 1, "query": 2}}]}'),
        (5, 0, "assistant", '{"role": "user", "tool_calls": [{"id": "a", "name": "search", "arguments": {}}]}'),
        (6, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"limit": big}}]})),
    ]
    got = {(r[0], r[2]): r for r in formatted(spark, rows)}
    assert got[(1, 0)][9] == '{"content":null,"note":{"a":2,"b":1},"role":"assistant","tool_calls":[{"arguments":{"query":"x"},"id":"a","name":"search","type":"function"}]}'
    assert got[(1, 1)][9] == '{"content":{"a":1.5,"z":[1,{"x":null,"y":2}]},"name":"n","role":"tool","tool_call_id":"a"}' and got[(1, 1)][4] == "result"
    assert json.loads(got[(2, 0)][9])["tool_calls"][0]["arguments"] == json.dumps({"query": "x", "limit": big}) and got[(2, 0)][8] is False
    assert json.loads(got[(3, 0)][9])["tool_calls"][0]["arguments"] == '{"query": 1, "query": 2}'
    for c in (4, 5, 6):
        assert got[(c, 0)][4] == "message" and json.loads(got[(c, 0)][9]) == {"content": rows[c][3], "role": "assistant"}


def test_nested_schemas(spark):
    cases = [({"query": "x", "filters": [{"field": "a", "values": ["b"]}, {"field": "c"}]}, True), ({"query": "x", "filters": [{"values": ["b"]}]}, False), ({"query": "x", "filters": [{"field": "a", "values": [1]}]}, False), ({"query": "x", "filters": []}, True), ({"query": None}, False)]
    rows = [(i, 0, "assistant", call(("a", "search", a))) for i, (a, _) in enumerate(cases)] + [(50, 0, "assistant", call(("a", "weather", {"city": "x", "unit": "celsius"}))), (51, 0, "assistant", call(("a", "weather", {"city": "x", "unit": "kelvin"})))]
    assert [r[8] for r in formatted(spark, rows)] == [v for _, v in cases] + [True, False]


def direct(rows):
    """(conv, position, turn, status, call_id, n_answered), message by message."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2], r[3]))
        owner, first, placed = {}, {}, []
        for _, turn, role, text in own:
            if role == "assistant" and text.startswith("{"):
                for k, c in enumerate(json.loads(text)["tool_calls"]):
                    owner.setdefault(c["id"], (turn, k))
            if role == "tool":
                first.setdefault(json.loads(text)["tool_call_id"], (turn, text))
        for _, turn, role, text in own:
            if role == "tool":
                i = json.loads(text)["tool_call_id"]
                status = "orphan" if i not in owner else "result" if first[i] == (turn, text) else "duplicate"
                key = (owner[i][0], 1, owner[i][1]) if status == "result" else (turn, 2, 0)
                placed.append((key, role, text, turn, status, i, 0))
            elif role == "assistant" and text.startswith("{"):
                placed.append(((turn, 0, 0), role, text, turn, "calls", None, sum(owner[i][0] == turn and i in first for i in owner)))
            else:
                placed.append(((turn, 0, 0), role, text, turn, "message", None, 0))
        out += [(conv, n, turn, status, i, answered) for n, (_, _, _, turn, status, i, answered) in enumerate(sorted(placed))]
    return sorted(out, key=str)


def test_many_conversations_against_direct_linking(spark):
    """Calls, results before and after them, repeated identifiers and rows, and one conversation with a third of all rows."""
    rng, rows = np.random.default_rng(8), []
    for conv in [*range(60), *[7] * 40]:
        base = 0 if conv != 7 else 100 * len(rows)
        for turn in range(12):
            kind, ids = rng.random(), [f"c{int(rng.integers(8))}-{base}" for _ in range(2)]
            if kind < 0.3:
                rows.append((conv, base + turn, "assistant", call(*((i, "search", {"query": "x"}) for i in dict.fromkeys(ids)))))
            elif kind < 0.6:
                rows.append((conv, base + turn, "tool", result(ids[0], f"r{int(rng.integers(3))}")))
            else:
                rows.append((conv, base + turn, "user", f"u{int(rng.integers(3))}"))
    rows += rows[5:9]  # repeated rows
    got = formatted(spark, rows)
    assert sorted(((r[0], r[1], r[2], r[4], r[5], r[7]) for r in got), key=str) == direct(rows)


def test_table_against_direct_json(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.format_chats(turns).collect()
    by = {(r["conv_id"], r["position"]): r for r in got}
    convs = {}
    for r in turns.collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert len(got) == sum(map(len, convs.values()))
    for c, rows in convs.items():
        for position, (turn, role, text) in enumerate(sorted(rows)):
            r = by[(c, position)]
            assert (r["turn"], r["role"]) == (turn, role) and json.loads(r["json"]) == {"content": text, "role": role}


def test_odd_turns(spark):
    got = formatted(spark, [(None, None, None, None), (1, 0, "assistant", "{not json"), (1, 0, "assistant", "{not json"), (1, 1, "tool", ""), (2, 0, "tool", result("a", "first")), (2, 1, "assistant", call(("a", "search", {"query": "q"})))])
    assert len(formatted(spark, [(1, 0, "user", "x" * 3_000_000)])[0][9]) == 3_000_000 + len('{"content":"","role":"user"}')
    assert [r[9] for r in got if r[0] is None] == ['{"content":null,"role":null}']
    assert [r[4] for r in got if r[0] == 1] == ["message"] * 3
    assert [(r[4], r[2]) for r in got if r[0] == 2] == [("calls", 1), ("result", 0)]
    assert formatted(spark, []) == []


def test_notices_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.scan(docs).where("confirmed").collect()}
    known = {"MIT License": "MIT", "Apache License": "Apache-2.0", "General Public License, version 3": "GPL-3.0", "CC BY-NC": "CC-BY-NC", "All rights reserved": "proprietary"}
    want = {}
    for r in docs.select("doc_id", "text").collect():
        for number, line in enumerate(r["text"].split("\n")):
            for words, family in known.items():
                if words in line:
                    want[(r["doc_id"], number)] = family
    assert len(want) > 200 and found == want


def test_unknown_text_and_held_out_notices():
    model = licenses.fit()
    for text in (*licenses.NEAR_MISSES, "Der Hund kommt mit.", "The quick brown fox."):
        assert not [r for r in licenses.classify(text.encode(), model) if r[6]], text
    for text, family in (("This file is licensed under the Apache License 2.0", "Apache-2.0"), ("Code released under the MIT license, see LICENSE.", "MIT"), ("licensed under a Creative Commons Attribution-ShareAlike 3.0 license", "CC-BY-SA"), ("Subject to the Mozilla Public License 2.0", "MPL-2.0"), ("GNU Affero General Public License v3 or later applies", "AGPL")):
        assert [r[2] for r in licenses.classify(text.encode(), model)] == [family], text


WRAPPED = {
    "MIT": licenses.TEMPLATES["MIT"][3],
    "ISC": licenses.TEMPLATES["ISC"][1],
    "BSD": licenses.TEMPLATES["BSD"][6],
    "GPL-3.0": licenses.TEMPLATES["GPL-3.0"][1],
    "EPL-2.0": licenses.TEMPLATES["EPL-2.0"][0],
    "Apache-2.0": licenses.TEMPLATES["Apache-2.0"][2],
}


@pytest.mark.parametrize("family", WRAPPED)
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices_are_one_paragraph(family, mark):
    lines = textwrap.wrap(WRAPPED[family], 70)
    text = "Oulen ba regi.\n\n" + "".join(f"{mark}{x}\n" for x in lines) + f"{mark}\nNoru te vaki so lemi.\n"
    confirmed = [r for r in licenses.classify(text.encode(), licenses.fit()) if r[6]]
    assert {r[2] for r in confirmed} == {family} and confirmed[0][0] >= 2 and sum(r[1] for r in confirmed) > 0.5 * len(lines)


#: Notices of licences that neither the families nor the examples of others hold.
UNSEEN = (
    "Licensed under the Academic Free License version 3.0.",
    "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.",
    "This file is part of the toolkit and may be distributed under the terms of the Q Public License.",
    "Made available under the Open Database License.",
    "This work is placed under the terms of the GNU Free Documentation License, Version 1.3.",
    "Use is subject to the terms of the Oracle Technology Network agreement.",
    "Released under the Ruby license, with exceptions listed below.",
    "Covered by the Educational Community License, version 1.0.",
)


def test_unseen_licences_are_confirmed_as_nothing():
    model = licenses.fit()
    found = [r for t in UNSEEN for r in licenses.classify(t.encode(), model)]
    assert not [r for r in found if r[6]]
    assert sum(r[2] == licenses.UNKNOWN for r in found) >= 2


def test_probabilities_are_calibrated_on_held_out_examples():
    params, model = licenses.LicenseParams(), licenses.fit()
    rows = [(licenses.probabilities(licenses.words_of(t.encode()), model), f) for t, f in licenses._examples(params, 7)]
    top = np.array([p.max() for p, _ in rows])
    right = np.array([model.families[int(p.argmax())] == f for p, f in rows])
    bins = np.digitize(top, [0.5, 0.7, 0.8, 0.9, 0.95])
    error = sum(abs(top[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))
    assert right.mean() > 0.9 and error < 0.06


def test_probabilities_equal_a_direct_softmax():
    model = licenses.fit()
    words = licenses.words_of(b"Released under the MIT License, and more.")
    grams = {(w,) for w in words} | set(zip(words, words[1:], strict=False))
    known = [g for g in grams if g in model.vocabulary]
    share = math.sqrt(sum(w in model.known or w in licenses._STOP for w in words) / len(words))
    z = [sum(model.weights[model.vocabulary[g], k] for g in known) * share / math.sqrt(len(known)) + model.weights[-1, k] for k in range(len(model.families))]
    e = [math.exp(x / model.temperature) for x in z]
    assert licenses.probabilities(words, model).tolist() == pytest.approx([x / sum(e) for x in e])


def test_long_text_is_read_whole():
    text = "Oulen ba regi the of.\n" * 200_000 + "Released under the MIT License."
    assert [(r[0], r[2]) for r in licenses.classify(text.encode(), licenses.fit())] == [(200_000, "MIT")]
    assert licenses.classify(b"of the and to", licenses.fit()) == []


def test_odd_documents(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x\nReleased under the MIT License.\n\nReleased under the MIT License.", "c")], "doc_id long, text string, family string")
    got = licenses.scan(df).collect()
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in got] == [(None, 1, "MIT"), (None, 3, "MIT")]
    assert licenses.scan(df.limit(0)).count() == 0
