import json
import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm.chat import canonical, fits, format_chats, refuse_unknown, whole_chats

SCHEMA = {"search": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}


def chats(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.part): r for r in format_chats(df, SCHEMA, **more).collect()}


def call(*ids, arguments=None, depends=()):
    return json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": arguments or {"q": "é"}, "depends_on": list(depends)} for i in ids]})


def result(i, content="found"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_links_order_and_schemas(spark):
    rows = [
        (1, 0, "user", "Hi\n\"x\""),
        (1, 3, "assistant", call("a")),
        (1, 2, "tool", result("a")),  # before its call
        (1, 4, "tool", result("a", "again")),
        (1, 5, "tool", result("nobody")),
        (1, 6, "assistant", "done"),
        (2, 0, "assistant", call("x", "y", arguments={"q": 1})),
        (2, 1, "tool", result("y")),
        (3, 0, "assistant", call("p", depends=["q"])),
        (3, 1, "assistant", call("q", arguments='{"n": 2, "q": "z"}')),
        (3, 2, "tool", result("q")),
        (4, 0, "assistant", call("m", depends=["k"])),
        (4, 1, "tool", result("m")),
        (4, 2, "assistant", call("k", depends=["m"])),
        (4, 3, "tool", result("k")),
        (5, 0, "user", None),
        (5, 0, "user", None),
        (None, None, None, "{not json"),
        (6, 0, "assistant", '{"tool_calls": "x"}'),
        (6, 1, "tool", "plain"),
        (None, 1, "tool", result("a")),
        (7, None, "user", "last"),
        (7, 9, "user", "first"),
        (8, 0, "assistant", json.dumps({"tool_calls": [{"id": "u", "name": "nothing"}]})),
    ]
    got = chats(spark, rows)
    one = json.loads(got[1, 0].chat)
    assert [m["role"] for m in one] == ["user", "assistant", "tool", "assistant"]
    assert one[0]["content"] == 'Hi\n"x"' and one[2]["content"] == "found"
    assert (got[1, 0].n_calls, got[1, 0].n_linked, got[1, 0].n_invalid, got[1, 0].n_left_out) == (1, 1, 0, 2)
    assert (got[2, 0].n_calls, got[2, 0].n_linked, got[2, 0].n_invalid) == (2, 1, 2)
    three = json.loads(got[3, 0].chat)
    assert [m.get("tool_call_id") or m["tool_calls"][0]["id"] for m in three] == ["q", "q", "p"] and three[0]["tool_calls"][0]["arguments"] == {"n": 2, "q": "z"}
    assert got[4, 0].cyclic and got[4, 0].n_messages == 4
    assert not any(r.cyclic for k, r in got.items() if k[0] != 4)
    assert got[5, 0].chat == '[{"content":"","role":"user"}]'
    assert got[6, 0].n_messages == 2 and got[6, 0].n_calls == 0
    assert [m["content"] for m in json.loads(got[7, 0].chat)] == ["first", "last"]
    assert (got[8, 0].n_calls, got[8, 0].n_unknown, got[8, 0].n_invalid) == (1, 1, 0)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "conv": F.lit("x"), "calls": F.lit(2)})
    every = sorted(map(tuple, format_chats(df, SCHEMA).collect()), key=str)
    # A message without conv_id is a conversation of its own.
    assert sorted(r[-1] for r in every if r[0] is None) == ["[]", '[{"content":"{not json","role":""}]']
    assert sorted(map(tuple, format_chats(df, SCHEMA, edges_at_once=0).collect()), key=str) == every
    parts = {r.conv_id: r.chat for r in whole_chats(format_chats(df, SCHEMA, messages_a_part=2)).collect() if r.conv_id is not None}
    assert parts == {r[0]: r[-1] for r in every if r[0] is not None}


def test_parts_hold_all_messages(spark):
    rng = random.Random(1)
    rows = [(7, t, "user", f"m{t}") for t in range(50)]
    rng.shuffle(rows)
    got = chats(spark, rows, messages_a_part=8)
    assert [m["content"] for p in sorted(got) for m in json.loads(got[p].chat)] == [f"m{t}" for t in range(50)]
    assert max(r.n_messages for r in got.values()) == 8
    assert chats(spark, []) == {}


def test_long_text(spark):
    text = "é" * 300_000
    assert json.loads(chats(spark, [(1, 0, "user", text)])[1, 0].chat)[0]["content"] == text


def test_fits_and_canonical():
    assert canonical({"b": 1, "a": "é\n"}) == '{"a":"é\\n","b":1}'
    assert fits({"q": "x", "n": 1}, SCHEMA["search"]) and not fits({"q": "x", "n": 0}, SCHEMA["search"])
    assert not fits({"q": "x", "z": 1}, SCHEMA["search"]) and not fits({"n": 1}, SCHEMA["search"]) and not fits([], SCHEMA["search"])
    assert fits([1, "a"], {"type": "array", "items": {"type": ["integer", "string"]}}) and not fits(True, {"type": "integer"})
    assert fits("b", {"enum": ["a", "b"]}) and not fits("c", {"enum": ["a", "b"]}) and not fits("abc", {"maxLength": 2})


def test_schemas_with_other_keywords_are_refused():
    refuse_unknown(SCHEMA["search"])
    for bad in ({"pattern": "a"}, {"properties": {"a": {"anyOf": []}}}, {"items": {"$ref": "#"}}, {"additionalProperties": {"format": "date"}}, 3):
        with pytest.raises(ValueError):
            refuse_unknown(bad)
    assert not fits([1], {"minItems": 2}) and not fits([1, 2], {"maxItems": 1})
