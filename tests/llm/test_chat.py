"""Tool calls: links, order, validation and canonical JSON."""

import json

import pytest
from pyspark.sql import functions as F

from vaultferry.llm import chat

SCHEMAS = {
    "add": {"a": chat.Param("integer"), "b": chat.Param("number", least=0, most=10)},
    "say": {
        "text": chat.Param("string", least=1, most=5),
        "tone": chat.Param("string", required=False, one_of=("low", "high")),
    },
    "set": {"on": chat.Param("boolean"), "list": chat.Param("array", required=False),
            "map": chat.Param("object", required=False)},
}

FAULTS = [
    ("add", '{"a": 1, "b": 2.5}', None),
    ("add", '{"b": 0, "a": -3}', None),
    ("add", '{"a": 1.5, "b": 2}', "a: not integer"),
    ("add", '{"a": 1}', "b: missing"),
    ("add", '{"a": 1, "b": 11}', "b: above 10"),
    ("add", '{"a": 1, "b": -1}', "b: below 0"),
    ("add", '{"a": null, "b": 1}', "a: missing"),
    ("add", '{"a": 1, "b": 1, "zz": 1, "c": 2}', "c: not in schema"),
    ("add", "not json", "arguments: not object"),
    ("add", "[1]", "arguments: not object"),
    ("add", None, "arguments: not object"),
    ("say", '{"text": "hello"}', None),
    ("say", '{"text": "", "tone": "low"}', "text: below 1"),
    ("say", '{"text": "toolong"}', "text: above 5"),
    ("say", '{"text": 5}', "text: not string"),
    ("say", '{"text": "ok", "tone": "loud"}', "tone: not listed"),
    ("set", '{"on": true, "list": [1], "map": {"x": 1}}', None),
    ("set", '{"on": "true"}', "on: not boolean"),
    ("set", '{"on": false, "list": {}}', "list: not array"),
    ("other", "{}", "unknown tool"),
    (None, "{}", "unknown tool"),
]


def test_faults(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(FAULTS)], "n int, tool string, args string, want string")
    got = df.select("n", chat.argument_fault(F.col("tool"), F.col("args"), SCHEMAS).alias("fault"))
    assert [r.fault for r in got.orderBy("n").collect()] == [f[2] for f in FAULTS]


def test_canonical_json(spark):
    texts = ['{"b": [1, {"d": 2, "c": "é"}], "a": null}', '{ "a" : "x\\ny" }', "oops", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = [r.j for r in df.select("n", chat.canonical(F.col("t")).alias("j")).orderBy("n").collect()]
    assert got == ['{"a":null,"b":[1,{"c":"é","d":2}]}', '{"a":"x\\ny"}', None, None]


def tables(spark, messages=(), calls=(), results=()):
    return (
        spark.createDataFrame(list(messages), "conv_id bigint, turn bigint, role string, text string"),
        spark.createDataFrame(
            list(calls),
            "conv_id bigint, turn bigint, call_id string, tool string, arguments string, after array<string>",
        ),
        spark.createDataFrame(
            list(results), "conv_id bigint, turn bigint, call_id string, content string"
        ),
    )


ARGS = '{"b": 1, "a": 2}'


def test_order_links_and_states(spark):
    messages = [(1, 0, "user", "hi"), (1, 9, None, None), (2, 0, "user", "x"), (None, 0, "user", "y")]
    calls = [
        (1, 3, "c1", "add", ARGS, ["c2"]),  # needs a call that is logged later
        (1, 5, "c2", "add", ARGS, None),
        (1, 6, "c3", "add", ARGS, ["c1", "nowhere"]),
        (1, 7, "c3", "add", ARGS, None),  # repeats an identifier
        (2, 1, "c1", "add", ARGS, None),  # the same identifier in another conversation
        (2, 2, None, "add", "{", None),
    ]
    results = [
        (1, 2, "c2", "before its call"),
        (1, 6, "c1", "6"),
        (1, 8, "c1", "again"),
        (1, 8, "zz", "orphan"),
        (2, 3, None, None),
    ]
    got = chat.formatted(*tables(spark, messages, calls, results), SCHEMAS).collect()
    assert len(got) == len(messages) + len(calls) + len(results)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(len(one)))
    place = {(r.kind, r.call_id, r.turn): r.position for r in one}
    assert place["call", "c2", 5] < place["result", "c2", 2]
    assert place["call", "c2", 5] < place["call", "c1", 3] < place["call", "c3", 6]
    assert place["call", "c1", 3] < place["result", "c1", 6]
    states = {(r.kind, r.call_id, r.turn): r.state for r in one}
    assert states["call", "c1", 3] == "answered" and states["call", "c3", 6] == "unanswered"
    assert states["call", "c3", 7] == "repeated" and states["result", "c1", 8] == "repeated"
    assert states["result", "zz", 8] == "orphan"
    for r in got:
        assert json.loads(r.json) is not None
        assert r.kind == "message" or list(json.loads(r.json)) == sorted(json.loads(r.json))
    call = next(r for r in one if r.call_id == "c1" and r.kind == "call")
    assert call.json == '{"arguments":{"a":2,"b":1},"id":"c1","name":"add","type":"call"}'
    broken = next(r for r in got if r.conv_id == 2 and r.turn == 2)
    assert json.loads(broken.json)["arguments"] == "{" and broken.fault == "arguments: not object"
    assert broken.state == "unanswered"


def test_cycles_are_reported(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROUNDS", 4)
    calls = [(1, 1, "a", "add", ARGS, ["b"]), (1, 2, "b", "add", ARGS, ["a"]), (1, 3, "c", "add", ARGS, None)]
    got = chat.formatted(*tables(spark, calls=calls), SCHEMAS).orderBy("position").collect()
    assert [r.call_id for r in got] == ["a", "b", "c"]
    assert [r.fault for r in got] == ["needs do not settle"] * 2 + [None]


def test_long_chains_and_rings_apart(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROUNDS", 2)
    calls = [(1, n, f"c{n}", "add", ARGS, [f"c{n + 1}"]) for n in range(6)]  # last to first
    calls += [(1, 6, "c6", "add", ARGS, None)]
    calls += [(2, 1, "a", "add", ARGS, ["b"]), (2, 2, "b", "add", ARGS, ["a"])]  # a ring
    calls += [(2, 0, "z", "none", ARGS, ["b"])]  # behind the ring, with a fault of its own
    calls += [(2, 3, "s", "add", ARGS, ["s"])]  # needs itself
    calls += [(2, 5, "x", "add", ARGS, ["y", "a"]), (2, 7, "y", "add", ARGS, None)]
    got = chat.formatted(*tables(spark, calls=calls), SCHEMAS).collect()
    found = {c: [(r.call_id, r.fault) for r in sorted(got, key=lambda r: r.position) if r.conv_id == c] for c in (1, 2)}
    assert found[1] == [(f"c{n}", None) for n in range(6, -1, -1)]
    ring = "needs do not settle"
    assert found[2] == [
        ("a", ring), ("b", ring), ("z", "unknown tool"), ("s", ring), ("y", None), ("x", None)
    ]


def test_long_conversation(spark):
    messages = [(1, n, "user", "x" * (n % 7)) for n in range(3000)]
    got = chat.formatted(*tables(spark, messages=messages), SCHEMAS).collect()
    assert sorted((r.position, r.turn) for r in got) == [(n, n) for n in range(3000)]


def test_rows_without_conversation_are_one(spark):
    """So many of them that a range sort spreads them over partitions."""
    messages = [(None, n, "user", "x" * (n % 7)) for n in range(3000)] + [(1, 5, "user", "z")]
    calls = [(None, 40, "a", "add", ARGS, ["b"]), (None, 50, "b", "add", ARGS, None)]
    results = [(None, 41, "a", "early"), (None, 60, "b", "6"), (1, 6, "b", "elsewhere")]
    messages, calls, results = tables(spark, messages, calls, results)
    got = chat.formatted(messages.repartition(8), calls, results, SCHEMAS).collect()
    own = sorted((r for r in got if r.conv_id is None), key=lambda r: r.position)
    assert [r.position for r in own] == list(range(3004))
    assert [r.turn for r in own if r.kind == "message"] == list(range(3000))
    linked = [(r.kind, r.call_id, r.state) for r in own if r.kind != "message"]
    assert linked == [
        ("call", "b", "answered"), ("call", "a", "answered"),
        ("result", "a", "result"), ("result", "b", "result"),
    ]
    assert [r.position for r in got if r.conv_id == 1] in ([0, 1], [1, 0])
    assert [r.state for r in got if r.conv_id == 1 and r.kind == "result"] == ["orphan"]


def test_empty_tables(spark):
    assert chat.formatted(*tables(spark), SCHEMAS).collect() == []


@pytest.mark.parametrize("text", ['quote " back \\ slash', "tab\tnew\nline", "\u0001 é 𝄞"])
def test_texts_survive(spark, text):
    got = chat.formatted(*tables(spark, [(1, 0, "user", text)]), SCHEMAS).first()
    assert json.loads(got.json) == {"content": text, "role": "user"}
