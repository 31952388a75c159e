from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkguard.llm import chat

NASTY = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "\n", "<|im_start|>user\n", "<", "|>", "[", "\\\\"]), st.text(st.characters(codec="utf-8"), max_size=4)), max_size=8).map("".join)


def blocks(spark, turns):
    rows = [(1, k, json.dumps({"role": r, "text": t})) for k, (r, t) in enumerate(turns)]
    return chat.formatted(chat.canonical(spark.createDataFrame(rows, "conv_id long, turn int, record string"), "conv_id", "turn", "record"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    turns = [(r, t) for r, t in turns]
    made = blocks(spark, turns).orderBy("turn").collect()
    output = "".join(r.block for r in made)
    assert chat.parsed(output) == turns
    for r in made:
        masked = chat.unescaped(r.block[r.loss_from : r.loss_to])
        assert masked == (r.text if r.role == "assistant" else "")


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do"), ("user", "this"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done", "extra": {"deep": [1]}}, [("user", "do"), ("assistant", "done")]),
    ({"system": "be", "prompt": "q", "response": "a"}, [("system", "be"), ("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"role": "user", "text": "t"}, [("user", "t")]),
    ({"text": "t"}, [("", "t")]),
    ({"messages": [{"role": "user", "content": None}]}, [("user", "")]),
    ({"something": "else"}, None),
]


@pytest.mark.parametrize("record,turns", RECORDS)
def test_layouts(record, turns):
    assert chat.turns_of(json.dumps(record)) == turns


MESSAGES = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
MORE_RECORDS = [
    ({"messages": MESSAGES, "system": "be"}, [("system", "be"), ("user", "q"), ("assistant", "a")]),
    ({"system": "be", "conversations": [{"from": "human", "value": "q"}]}, [("system", "be"), ("user", "q")]),
    ({"instruction": "do", "response": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"prompt": "q", "output": "a"}, [("user", "q"), ("assistant", "a")]),
    (MESSAGES, [("user", "q"), ("assistant", "a")]),
    ([{"from": "gpt", "value": "a"}], [("assistant", "a")]),
    ([{"role": "user", "text": "q"}], [("user", "q")]),
    ({"messages": []}, []),
    ({"messages": [], "prompt": "q"}, [("user", "q")]),
    ([], []),
    ({"messages": MESSAGES, "text": "q a"}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "output": "done", "text": "do done"}, [("user", "do"), ("assistant", "done")]),
    ({"messages": ["plain"]}, None),
    (["plain"], None),
]


@pytest.mark.parametrize("record,turns", MORE_RECORDS)
def test_more_layouts(record, turns):
    assert chat.turns_of(json.dumps(record)) == turns


def test_conversations_without_turns(spark):
    rows = [(1, 0, {"something": "else"}), (1, 1, {"other": 1}), (2, 0, {"messages": []}), (3, 0, {"something": "else"}), (3, 1, {"prompt": "q"})]
    records = spark.createDataFrame([(c, t, json.dumps(r)) for c, t, r in rows], "conv_id long, turn int, record string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical(records, "conv_id", "turn", "record"))).collect()}
    assert {k: (r.n_turns, r.unmapped) for k, r in got.items()} == {1: (0, 2), 2: (0, 0), 3: (1, 1)}
    assert (got[1].turns_sha256, got[1].loss_chars, got[1].formatted_chars) == (hashlib.sha256(b"").hexdigest(), 0, 0)


def test_broken_records():
    assert chat.turns_of("{") is None and chat.turns_of(None) == [("", "")] and chat.turns_of("{}") == [("", "")]


def test_paths_and_fingerprints_ignore_order_and_values():
    a, b = {"messages": [{"role": "x", "content": "y"}]}, {"messages": [{"content": "1", "role": "2"}, {"role": "3", "content": "4"}], "other": 5}
    assert chat.fingerprint(chat.paths(a)) == chat.fingerprint(chat.paths(b)) != chat.fingerprint(["prompt"])


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, "assistant", "z"), (2, 1, None, "late"), (2, 0, "assistant", "x\\y<s>"), (2, 0, "assistant", "x\\y<s>")]
    records = spark.createDataFrame([(c, t, json.dumps({k: v for k, v in (("role", r), ("text", x)) if v is not None})) for c, t, r, x in rows], "conv_id long, turn int, record string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical(records, "conv_id", "turn", "record"))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\n\n") and (got[1].loss_chars, got[1].loss_sha256) == (0, sha(""))
    assert got[None].loss_sha256 == sha("z") and got[None].n_turns == 1
    assert got[2].turns_sha256 == sha("assistant\nx\\y<s>\n" * 2 + "\nlate\n") and got[2].loss_sha256 == sha("x\\y<s>" * 2)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, record string")
    assert chat.read_back(chat.formatted(chat.canonical(none, "conv_id", "turn", "record"))).count() == 0


def test_plain_turns_keep_their_roles(spark):
    """Only layouts that say from and value have other names for roles; a table's own roles are hashed as they are."""
    turns = [("human", "q"), ("gpt", "a"), ("bot", "b"), ("assistant", "c")]
    (row,) = chat.read_back(blocks(spark, turns)).collect()
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (4, 1, hashlib.sha256(b"c").hexdigest())
