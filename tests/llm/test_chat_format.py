"""Chat formatting: exact round trips, declared layouts, digests against plain Python."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pageledger.llm import chat_format as C

PIECE = st.sampled_from([*C.ALL_MARKS, "\\", "[", "]", "<", ">", "/", "INST]", "s>", "<\\s>", "[\\\\INST]", "a", " ", "\n", "é", "<<", "SYS>>", "[/\\ROLE]"])
TEXT = st.lists(PIECE, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=5))
def test_turns_come_back(turns):
    text, mask = C.formatted(iter(turns))
    assert list(C.turns_of(text)) == turns
    assert [C.unescaped(text[s : s + n]) for s, n in mask] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:
        assert not any(m in C.escaped(t) for m in C.ALL_MARKS)


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"completion": "c"}, "completion", [("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "r", "id": 7}, "response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": None, "output": 5}, "instruction with input", [("user", "i"), ("user", ""), ("assistant", "5")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "b", "name": "n"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("tool", "b"), ("assistant", "")]),
        ({"messages": []}, "messages", []),
        ({"system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "x", "value": "c"}]}, "shared", [("system", "s"), ("user", "a"), ("assistant", "b"), ("x", "c")]),
        ({"conversation": {"turns": [{"speaker": "bot", "text": "t"}]}}, "nested messages", [("assistant", "t")]),
        ({"question": {"text": "q"}, "answer": {"text": "a"}}, "nested answer", [("user", "q"), ("assistant", "a")]),
        ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ],
)
def test_layouts(record, layout, turns):
    name, text, _ = C.format_record(json.dumps(record), C.fingerprints())
    assert name == layout and list(C.turns_of(text)) == turns
    turned = json.dumps(dict(reversed(record.items())))
    assert C.format_record(turned, C.fingerprints())[:2] == (name, text)


@pytest.mark.parametrize("record", [None, "", "not json", "[1]", "7", "null", '{"prompt": "p", "other": 1}', '{"id": 1}', "{}", '{"messages": [{"role": "user"}]}', '{"messages": "x"}', '{"messages": ["x"]}', '{"messages": [{}]}', '{"a.b": 1}'])
def test_unknown_layouts_are_left_out(record):
    assert C.format_record(record, C.fingerprints()) == (None, None, [])


def test_paths_of_odd_names_differ():
    assert C.fingerprint(set(C.field_paths({"a.b": 1}))) != C.fingerprint(set(C.field_paths({"a": {"b": 1}})))
    assert set(C.field_paths({"a": [{"b": 1}, {"c": []}], "d": {}})) == {"a[].b", "a[].c[0]", "d"}


def test_conversations_against_plain_python(spark):
    rnd, rows = random.Random(3), []
    for conv in range(50):
        for turn in range(rnd.randrange(1, 7)):
            rows.append((conv, turn, rnd.choice(("user", "assistant", "system", "tool", None, "", "[/ROLE]")), rnd.choice(("plain", "", None, "</s> [INST]\n", "[\\INST] \\ <s>", "ü中\u0000", '"q" \\n {}'))))
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (70, 1, "assistant", "same"), (70, 1, "assistant", "same"), (71, 0, "assistant", "<s>" * 100_000), (71, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("record", "tie", "formatted", "loss", "layout", "id"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r.conv_id: r for r in C.formatted_conversations(spark, df).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", C.escaped(text or ""), text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = [t[4] for t in turns if t[2] == "assistant"]
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), sum(map(len, said)))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[4]}\n" for t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert r.formatted_chars == len(C.formatted(iter([(t[2], t[4]) for t in turns]))[0])


def test_unmapped_records_and_empty_table(spark):
    records = spark.createDataFrame([(1, 0, "", '{"prompt": "p"}'), (1, 1, "", '{"unknown": "p"}'), (2, 0, "", None)], "conv_id long, turn long, tie string, record string")
    assert sorted(map(tuple, C.unmapped(records).collect())) == [(1, 1, ""), (2, 0, "")]
    assert [tuple(r)[:2] for r in C.read_back(C.format_records(records)).collect()] == [(1, 1)]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in C.formatted_conversations(spark, empty).collect()] == [-1]
