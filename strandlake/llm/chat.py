"""Chat formatting with tool-call linking.

Calls and results are hash-joined by conversation and identifier, messages are put into topological order (a result after
its call, a call after the results it depends on, else by turn), arguments are validated against the tools' schemas, and
conversations are serialised as canonical JSON.

A message's text is a tool call message if its role is assistant and it is a JSON object with a list "tool_calls" of
{"id", "name", "arguments"[, "depends_on"]}, and a result if its role is tool and it is an object with "tool_call_id".
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, forget, written

#: Messages of a part, and dependencies of a conversation up to which it is put in order in one go.
MESSAGES_A_PART, EDGES_AT_ONCE = 1024, 4096
#: Where a message without a turn stands.
LAST = 1 << 62

_PARSED = "conv_id long, turn long, m long, message string, calls array<struct<id:string,known:boolean,valid:boolean,depends:array<string>>>, answers string"


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space, and no escapes but those that JSON asks for."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return kind in _TYPES and isinstance(value, _TYPES[kind])


#: Keywords that fits() knows, and those that ask for nothing.
_CHECKED = {"type", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "items", "properties", "required", "additionalProperties"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly"}


def refuse_unknown(schema: object) -> None:
    """Raises ValueError for a schema with a keyword that fits() does not look at."""
    if not isinstance(schema, dict):
        raise ValueError(f"not a schema: {schema!r}")
    if unknown := set(schema) - _CHECKED - _NOTES:
        raise ValueError(f"keywords that are not supported: {sorted(unknown)}")
    more = schema.get("additionalProperties", True)
    for part in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else []), *([more] if not isinstance(more, bool) else [])]:
        refuse_unknown(part)


def fits(value: object, schema: dict) -> bool:
    """Whether value fits the schema, by the keywords in _CHECKED."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        return False
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if _is(value, "number") and not (schema.get("minimum", value) <= value <= schema.get("maximum", value)):
        return False
    if isinstance(value, str) and not (schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))):
        return False
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return False
        if "items" in schema and not all(fits(x, schema["items"]) for x in value):
            return False
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())):
            return False
        for k, x in value.items():
            if k in known:
                if not fits(x, known[k]):
                    return False
            elif more is False or isinstance(more, dict) and not fits(x, more):
                return False
    return True


def _object(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text, parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _arguments(call: dict) -> object:
    """A call's arguments; given as a string, they are JSON in JSON."""
    value = call.get("arguments", {})
    if isinstance(value, str):
        try:
            return json.loads(value, parse_constant=lambda _: None)
        except (ValueError, RecursionError):
            return value
    return value


def parsed(role: str, text: str, schemas: dict[str, dict]) -> tuple[str, list[tuple[str, bool, bool, list[str]]], str | None]:
    """Canonical message, its calls (id, whether there is a schema, whether the arguments fit it, ids it depends on), and the
    id that it answers."""
    found = _object(text) if role in ("assistant", "tool") else None
    if found and role == "assistant" and isinstance(found.get("tool_calls"), list):
        calls, out = [], []
        for call in found["tool_calls"]:
            if isinstance(call, dict) and isinstance(call.get("id"), str):
                name, value = str(call.get("name", "")), _arguments(call)
                depends = [x for x in call.get("depends_on") or [] if isinstance(x, str)] if isinstance(call.get("depends_on"), list) else []
                calls.append((call["id"], name in schemas, name in schemas and fits(value, schemas[name]), depends))
                out.append({"arguments": value, "id": call["id"], "name": name})
        if calls:
            return canonical({"content": found.get("content") or "", "role": role, "tool_calls": out}), calls, None
    if found and role == "tool" and isinstance(found.get("tool_call_id"), str):
        return canonical({"content": found.get("content", ""), "role": role, "tool_call_id": found["tool_call_id"]}), [], found["tool_call_id"]
    return canonical({"content": text, "role": role}), [], None


def _parse(conversations: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each message: conv (the conversation's key), m (a hash that names the message), tie (its order among others
    of its place)."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, turn, role, text, m in it:
            message, calls, answers = parsed(role or "", text or "", schemas)
            yield conv_id, turn, m, message, [{"id": i, "known": k, "valid": v, "depends": d} for i, k, v, d in calls], answers

    given = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").distinct()
    found = arrow_rows(given.withColumn("m", F.xxhash64("turn", "role", "text")), _PARSED, rows)
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("m"), F.col("m").cast("string")))
    return found.withColumns({"conv": conv, "turn": F.coalesce("turn", F.lit(LAST)), "tie": F.md5(F.col("message").cast("binary"))})


_PLACED = "conv string, m long, turn long, level int, cyclic boolean"


def _at_once(edges: DataFrame) -> DataFrame:
    """_PLACED of the messages of the edges (conv, m, turn, on, on_turn), each conversation in one go."""

    def order(found: pa.Table) -> pa.Table:
        at: dict[int, tuple[int, int]] = {}
        waits, behind = defaultdict(int), defaultdict(list)
        for m, turn, on, on_turn in zip(*(found[c].to_pylist() for c in ("m", "turn", "on", "on_turn")), strict=True):
            at[m], at[on] = (turn, 0), (on_turn, 0)
            waits[m] += 1
            behind[on].append(m)
        own, ready = dict(at), [m for m in at if not waits[m]]
        for on in ready:  # grows
            for m in behind[on]:
                at[m] = max(at[m], (at[on][0], at[on][1] + 1))
                waits[m] -= 1
                if not waits[m]:
                    ready.append(m)
        rows = [(found["conv"][0].as_py(), m, *(own[m] if waits[m] else at[m]), waits[m] > 0) for m in at]
        return pa.table(dict(zip(("conv", "m", "turn", "level", "cyclic"), map(list, zip(*rows, strict=True)), strict=True)), schema=pa.schema([("conv", pa.string()), ("m", pa.int64()), ("turn", pa.int64()), ("level", pa.int32()), ("cyclic", pa.bool_())]))

    return edges.groupBy("conv").applyInArrow(order, _PLACED)


def _in_rounds(edges: DataFrame) -> DataFrame:
    """The same for conversations of any size: each round places the messages that wait for none that isn't placed."""
    key = ["conv", "m"]
    own = edges.select(*key, "turn").union(edges.select("conv", "on", "on_turn")).distinct()
    done = written(own.join(edges.select(*key).distinct(), key, "left_anti").select(*key, "turn", F.lit(0).alias("level")), "placed")
    todo = written(edges.select(*key, "turn", "on"), "todo")
    while True:
        each = todo.join(done.select("conv", F.col("m").alias("on"), F.struct("turn", (F.col("level") + 1).alias("level")).alias("before")), ["conv", "on"], "left")
        ready = each.groupBy(*key).agg(F.bool_and(F.col("before").isNotNull()).alias("all"), F.greatest(F.struct(F.min("turn").alias("turn"), F.lit(0).alias("level")), F.max("before")).alias("at")).where("all")
        ready = written(ready.select(*key, "at.turn", "at.level"), "ready")
        if ready.isEmpty():
            break
        old = done, todo, ready
        done, todo = written(done.union(ready), "placed"), written(todo.join(ready, key, "left_anti"), "todo")
        forget(*old)
    left = todo.select(*key, "turn").distinct().select(*key, "turn", F.lit(0).alias("level"), F.lit(True).alias("cyclic"))
    out = written(done.select("*", F.lit(False).alias("cyclic")).union(left), "places")
    forget(done, todo, ready)
    return out


def _ordered(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """_PLACED of messages in edges (conv, m, turn, on, on_turn; a written table): where m stands so that it comes behind those
    it depends on, else by its own turn. Messages on or behind a circle keep their turns and are cyclic."""
    sizes = edges.groupBy("conv").count()
    large = sizes.where(F.col("count") > at_once).select("conv")
    places = _at_once(edges.join(sizes.where(F.col("count") <= at_once).select("conv"), "conv", "left_semi"))
    if large.isEmpty():
        return places
    rest = written(edges.join(large, "conv", "left_semi"), "large")
    out = places.union(_in_rounds(rest))
    forget(rest)
    return out


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None, messages_a_part: int = MESSAGES_A_PART, edges_at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """conv_id, part, n_messages, n_calls, n_linked, n_unknown, n_invalid, n_left_out, cyclic, chat (a JSON array of messages).

    Of calls with the same identifier in a conversation the first counts, and so of results. Results that link with no call,
    and later results of a call, are left out of the chat and counted. n_unknown: calls of tools without a schema; n_invalid:
    calls whose arguments don't fit their schema. A schema with keywords beyond those of fits() is refused. Messages that
    stand at one place are in the order of their md5. Rows that repeat are one message. A null turn comes last, a null role or
    text is empty; a message without conv_id is a conversation of its own. Texts of any length are kept whole.

    A conversation comes in parts of messages_a_part messages by their order, so that no row grows with it: the arrays of
    parts 0, 1, ... one after another are the whole, and counts add up (whole_chats). An empty table gives none. Columns other
    than conv_id, turn, role, text are not read. The tables on the way are deleted, but for the last, which is read here.
    """
    for schema in (schemas or {}).values():
        refuse_unknown(schema)
    messages = written(_parse(conversations, schemas or {}), "messages")
    order = F.struct("turn", "tie", "m")
    calls = messages.select("conv", "turn", "tie", "m", F.inline("calls"))
    call = calls.groupBy("conv", "id").agg(F.min(order).alias("o")).select("conv", "id", F.col("o.m").alias("call"), F.col("o.turn").alias("call_turn"))
    results = messages.where("answers is not null").select("conv", "turn", "tie", "m", F.col("answers").alias("id"))
    first = results.groupBy("conv", "id").agg(F.min(order).alias("o")).select("conv", "id", F.col("o.m").alias("m"), F.col("o.turn").alias("turn"))
    linked = written(first.join(call, ["conv", "id"]), "linked")
    needs = calls.select("conv", "m", "turn", F.explode("depends").alias("id")).join(linked.select("conv", "id", F.col("m").alias("on"), F.col("turn").alias("on_turn")), ["conv", "id"])
    edges = written(linked.select("conv", "m", "turn", F.col("call").alias("on"), F.col("call_turn").alias("on_turn")).union(needs.select("conv", "m", "turn", "on", "on_turn")).distinct(), "edges")
    places = _ordered(edges, edges_at_once).withColumnsRenamed({"turn": "at_turn", "level": "at_level"})

    # Dealt by ranges of the order, so that a long conversation is put in order by many tasks.
    key = ["conv", "m"]
    placed = messages.join(places, key, "left").join(linked.select(*key, F.lit(True).alias("linked")), key, "left")
    placed = placed.withColumns({"at_turn": F.coalesce("at_turn", "turn"), "at_level": F.coalesce("at_level", F.lit(0)), "out": F.col("answers").isNotNull() & F.col("linked").isNull()})
    dealt = placed.repartitionByRange("conv", "at_turn", "at_level", "tie", "m").withColumn("task", F.spark_partition_id())
    dealt = written(dealt, "dealt")
    ahead = dealt.groupBy("conv", "task").agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("conv", "task").orderBy("at_turn", "at_level", "tie", "m"))
    numbered = dealt.withColumn("own", own).join(ahead.drop("n"), ["conv", "task"]).withColumn("position", F.col("ahead") + F.col("own") - 1)
    parts = numbered.groupBy("conv", "conv_id", F.floor(F.col("position") / messages_a_part).cast("int").alias("part")).agg(
        F.count(F.when(~F.col("out"), 1)).alias("n_messages"),
        F.sum(F.size("calls")).alias("n_calls"),
        F.count("linked").alias("n_linked"),
        F.sum(F.size(F.filter("calls", lambda c: ~c["known"]))).alias("n_unknown"),
        F.sum(F.size(F.filter("calls", lambda c: c["known"] & ~c["valid"]))).alias("n_invalid"),
        F.count(F.when(F.col("out"), 1)).alias("n_left_out"),
        F.max(F.coalesce("cyclic", F.lit(False))).alias("cyclic"),
        F.array_sort(F.collect_list(F.when(~F.col("out"), F.struct("position", "message")))).alias("items"),
    )
    forget(messages, linked, edges)
    chat = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["message"]), ","), F.lit("]"))
    return parts.select("conv_id", "part", "n_messages", "n_calls", "n_linked", "n_unknown", "n_invalid", "n_left_out", "cyclic", chat.alias("chat"))


def whole_chats(parts: DataFrame) -> DataFrame:
    """One row for each conversation with a conv_id: for those that are known to fit into one row. Messages without one stay
    rows of their own."""
    inner = F.expr("substring(chat, 2, char_length(chat) - 2)")
    some = parts.withColumn("inner", inner).withColumn("one", F.when(F.col("conv_id").isNull(), F.md5(F.col("chat").cast("binary"))))
    joined = some.groupBy("conv_id", "one").agg(
        *[F.sum(c).alias(c) for c in ("n_messages", "n_calls", "n_linked", "n_unknown", "n_invalid", "n_left_out")], F.max("cyclic").alias("cyclic"),
        F.transform(F.filter(F.array_sort(F.collect_list(F.struct("part", "inner"))), lambda x: x["inner"] != ""), lambda x: x["inner"]).alias("all"),
    )
    return joined.select("conv_id", "n_messages", "n_calls", "n_linked", "n_unknown", "n_invalid", "n_left_out", "cyclic", F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")).alias("chat"))
