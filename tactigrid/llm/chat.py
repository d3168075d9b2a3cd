"""Chat formatting with linked tool calls, in DataFrame functions only.

Rows are turns (conv_id, turn, role, text). An assistant turn whose text is a JSON object with `tool_calls` makes calls
(id, name, arguments); a `tool` turn whose text is a JSON object with `tool_call_id` is a result. Results are
hash-joined to calls by conversation and identifier. A result depends on its call, everything else on the turn before it:
the order is the topological one that is nearest to the turns. So a linked result stands right after the turn that called
it, in the order of that turn's calls, wherever it was given; everything else keeps its turn's place.

Arguments are validated against the tools' schemas (a subset of JSON Schema: type, properties, required, items, enum, at any
depth; properties that the schema doesn't name are errors). Each message is one row with canonical JSON: keys in
alphabetical order at every depth, no white space, nulls written, and every key of the given object kept. Arguments that
are a string holding JSON are written as that JSON.

No conversation is gathered in a task: equal rows are counted first, messages are dealt by ranges of (conversation, order),
and positions are counted in two levels, within a range and over the ranges.

Defined results, column `status`: `message` (no call, no result), `calls` (an assistant turn with calls), `result` (linked),
`orphan` (a result whose call is missing; stays in its place), `duplicate` (a further result of an answered call, or a
result in a turn after another with that identifier; stays in its place). If an identifier is called twice in a
conversation, the first call owns it. A call without an id stays in its turn's calls, can't be answered and isn't valid; a
turn none of whose calls has an id or a name is a message. Strings of arguments that aren't parseable JSON (or repeat a key,
or hold a number of more than 38 digits) are written as the strings that they were, and aren't valid. Text that isn't
one JSON object (or repeats a key, or holds such a number, or a role other than the turn's) is content, as it is. Numbers
with an exponent are written as doubles, decimals without the zeros at their end (1.0 as 1). A null text is null content, an empty one is empty. Null roles are written as null;
rows with null conv_id are one conversation; equal turns are ordered by role and text; repeated rows are repeated
messages; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.llm.common import checkpointed

#: Tool name -> schema of its arguments.
Tools = Mapping[str, Mapping]
DEFAULT_TOOLS: Tools = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "filters": {"type": "array", "items": {"type": "object", "properties": {"field": {"type": "string"}, "values": {"type": "array", "items": {"type": "string"}}}, "required": ["field"]}}}, "required": ["query"]},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "weather": {"type": "object", "properties": {"city": {"type": "string"}, "days": {"type": "integer"}, "metric": {"type": "boolean"}, "unit": {"enum": ["celsius", "fahrenheit"]}}, "required": ["city"]},
    "read_file": {"type": "object", "properties": {"path": {"type": "string"}}, "required": ["path"]},
}
_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "integer": r"(BIGINT|DECIMAL\(\d+,0\))", "number": r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}
_STRINGS = r'"(?:\\.|[^"\\])*+"'
_CALL = "struct<id:string,name:string,arguments:variant>"


def _parsed(text: Column) -> Column:
    """The variant of a JSON text, null if it isn't one or has a number that a variant can't hold."""
    long = F.regexp_replace(text, _STRINGS, '""').rlike(r"[0-9.]{39}")
    return F.when(~long, F.try_parse_json(text))


def _valid(value: Column, schema: Mapping) -> Column:
    """Whether a variant (not null) meets a schema."""
    verdict = F.lit(True)
    if kind := schema.get("type"):
        verdict &= F.schema_of_variant(value).rlike(f"(?s)^{_TYPES[kind]}$")
    if "enum" in schema:
        verdict &= F.coalesce(F.to_json(value).isin([_json(x) for x in schema["enum"]]), F.lit(False))
    if "properties" in schema:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        verdict &= F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, schema["properties"])))) == 0, F.lit(False))
        for key, own in schema["properties"].items():
            there = F.try_variant_get(value, f"$['{key}']", "variant")
            verdict &= F.when(there.isNull(), F.lit(key not in schema.get("required", ()))).otherwise(_valid(there, own))
    if "items" in schema:
        verdict &= F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: _valid(x, schema["items"])), F.lit(False))
    return verdict


def _json(value: object) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _given_arguments(call: Column) -> Column:
    """A call's arguments: what a string of JSON holds, else as they are."""
    inner = F.try_variant_get(call["arguments"], "$", "string")
    is_string = F.schema_of_variant(call["arguments"]) == "STRING"
    return F.when(is_string, F.coalesce(_parsed(inner), call["arguments"])).otherwise(call["arguments"])


def _valid_call(call: Column, tools: Tools) -> Column:
    verdict = F.lit(False)
    for name, schema in tools.items():
        verdict = F.when(call["name"] == name, _valid(_given_arguments(call), schema)).otherwise(verdict)
    return F.coalesce(call["id"].isNotNull() & call["arguments"].isNotNull() & verdict, F.lit(False))


def _object(keys: Column, **changed: Column) -> Column:
    """Canonical JSON of a map of variants with some keys set."""
    kept = F.map_filter(keys, lambda k, v: ~k.isin(list(changed)))
    return F.to_json(F.to_variant_object(F.map_concat(kept, F.create_map(*(x for k, v in changed.items() for x in (F.lit(k), v))))))


def _message(text: Column, role: Column) -> Column:
    return F.to_json(F.struct(text.alias("content"), role.alias("role")), {"ignoreNullFields": "false"})


def _tool_turns(turns: DataFrame, tools: Tools) -> tuple[DataFrame, Column]:
    """Turns with calls and results, equal rows counted, and the condition that finds turns that may be one."""
    may = F.coalesce(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{"), F.lit(False))
    d = turns.where(may).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("v", _parsed(F.col("text")))
    d = d.withColumn("keys", F.try_variant_get("v", "$", "map<string,variant>"))
    own_role = F.try_variant_get("v", "$.role", "string")
    usable = F.col("keys").isNotNull() & (own_role.isNull() & ~F.map_contains_key("keys", "role") | (own_role == F.col("role")))
    given = F.when((F.col("role") == "assistant") & usable, F.try_variant_get("v", "$.tool_calls", f"array<{_CALL}>"))
    named = F.exists(given, lambda x: x["id"].isNotNull() | x["name"].isNotNull())
    d = d.withColumn("calls", F.when(named, given)).withColumn("call_id", F.when((F.col("role") == "tool") & usable, F.try_variant_get("v", "$.tool_call_id", "string")))
    d = d.withColumn("valid", F.forall("calls", lambda x: _valid_call(x, tools)))
    null, role = F.parse_json(F.lit("null")), F.parse_json(F.to_json(F.array("role")))
    role = F.try_variant_get(role, "$[0]", "variant")
    content = F.coalesce(F.element_at("keys", "content"), null)
    each = F.try_variant_get("v", "$.tool_calls", "array<map<string,variant>>")
    call_of = lambda m: F.struct(m["arguments"].alias("arguments"))
    written = F.transform(each, lambda m: F.map_concat(F.map_filter(m, lambda k, v: k != "arguments"), F.create_map(F.lit("arguments"), F.when(m["arguments"].isNull(), null).otherwise(_given_arguments(call_of(m))))))
    complete = F.transform(written, lambda m: F.map_concat(F.map_filter(F.create_map(F.lit("id"), null, F.lit("name"), null), lambda k, v: ~F.map_contains_key(m, k)), m))
    calling = _object(F.col("keys"), role=role, content=content, tool_calls=F.to_variant_object(complete))
    answer = _object(F.col("keys"), role=role, content=content)
    json = F.when(F.col("calls").isNotNull(), calling).when(F.col("call_id").isNotNull(), answer).otherwise(_message(F.col("text"), F.col("role")))
    light = F.transform("calls", lambda x: x["id"])
    return d.select("conv_id", "turn", "role", "text", "n", light.alias("ids"), "call_id", "valid", json.alias("json")), may


def format_chats(turns: DataFrame, tools: Tools = DEFAULT_TOOLS) -> DataFrame:
    """conv_id, position (from 0), turn, role, status, call_id, n_calls, n_answered, valid (all calls of the turn), json."""
    rows = turns.select("conv_id", "turn", "role", "text")
    found, may = _tool_turns(rows, tools)
    found = checkpointed(found)
    plain = rows.where(~may).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))

    # The first call of an identifier, and the first result of it.
    called = found.where("ids is not null").select("conv_id", F.col("turn").alias("call_turn"), F.posexplode("ids").alias("call_index", "call_id")).where("call_id is not null")
    owner = called.groupBy("conv_id", "call_id").agg(F.min(F.struct("call_turn", "call_index")).alias("owner"))
    results = found.where("call_id is not null")
    first = results.groupBy(F.col("conv_id").alias("conv_r"), F.col("call_id").alias("id_r")).agg(F.min(F.struct("turn", "text")).alias("first"))
    linked = owner.join(first, F.col("conv_id").eqNullSafe(F.col("conv_r")) & (F.col("call_id") == F.col("id_r")), "left").select(F.col("conv_id").alias("conv_l"), F.col("call_id").alias("id_l"), "owner", "first")
    answered = linked.where("first is not null").groupBy(F.col("conv_l").alias("conv_a"), F.col("owner.call_turn").alias("turn_a")).agg(F.count("*").alias("n_answered"))

    nothing = {"call_id": F.lit(None).cast("string"), "n_calls": F.lit(0), "n_answered": F.lit(0), "valid": F.lit(None).cast("boolean")}
    place = lambda turn, kind, index: F.struct(turn.alias("turn"), F.lit(kind).alias("kind"), index.alias("index"))
    here = place(F.col("turn"), 0, F.lit(0))
    shape = ("conv_id", "turn", "role", "text", "n", "status", "call_id", "n_calls", "n_answered", "valid", "json", "key")
    messages = plain.select("conv_id", "turn", "role", "text", "n", F.lit("message").alias("status"), *(v.alias(k) for k, v in nothing.items()), _message(F.col("text"), F.col("role")).alias("json"), here.alias("key"))
    has_calls = F.col("ids").isNotNull()
    heads = found.where("call_id is null").join(answered, F.col("conv_id").eqNullSafe(F.col("conv_a")) & F.col("turn").eqNullSafe(F.col("turn_a")) & has_calls, "left")
    heads = heads.withColumns({"status": F.when(has_calls, "calls").otherwise("message"), "n_calls": F.when(has_calls, F.size("ids")).otherwise(0), "n_answered": F.coalesce("n_answered", F.lit(0)).cast("int"), "key": here}).select(*shape)
    joined = results.join(linked, F.col("conv_id").eqNullSafe(F.col("conv_l")) & (F.col("call_id") == F.col("id_l")), "left")
    is_first = F.struct("turn", "text").eqNullSafe(F.struct(F.col("first.turn"), F.col("first.text")))
    status = F.when(F.col("owner").isNull(), "orphan").when(is_first, "result").otherwise("duplicate")
    key = F.when(status == "result", place(F.col("owner.call_turn"), 1, F.col("owner.call_index"))).otherwise(place(F.col("turn"), 2, F.lit(0)))
    tails = joined.withColumns({"status": status, "n_calls": F.lit(0), "n_answered": F.lit(0), "valid": nothing["valid"], "key": key}).select(*shape)
    return _positioned(messages.unionByName(heads).unionByName(tails))


def _positioned(messages: DataFrame) -> DataFrame:
    """One row per message, with its position in its conversation: counted in ranges, then over the ranges."""
    order = ("key", "role", "text")
    dealt = checkpointed(messages.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "range").agg(F.sum("n").alias("of_range"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = counts.select(F.col("conv_id").alias("conv_b"), F.col("range").alias("range_b"), F.coalesce(F.sum("of_range").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("range", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = placed.join(bases, (F.col("range") == F.col("range_b")) & F.col("conv_id").eqNullSafe(F.col("conv_b")))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("conv_id", (F.col("base") + F.col("before") + F.col("copy")).alias("position"), "turn", "role", "status", "call_id", "n_calls", "n_answered", "valid", "json")
