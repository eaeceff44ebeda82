"""Chat formatting: exact round trips, layouts by fingerprint, conversations spread over tasks."""

import hashlib
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabguard.llm.chat import LAYOUTS, TEMPLATE, Each, Fields, Layout, Template, canonical_turns, chats_digest, format_chats, read_back, registry

ODD = st.text(st.sampled_from(list("#\\</turn>: \n\rAé😀\x00")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), max_size=5))
def test_round_trip(turns):
    text, masks = "", []
    for role, content in turns:
        turn, start, end = TEMPLATE.turn(role, content)
        masks.append((len(text) + start, len(text) + end))
        text += turn
    assert list(TEMPLATE.turns(text)) == turns
    assert [TEMPLATE.unescape(text[a:b]) for a, b in masks] == [c for _, c in turns]
    for _, content in turns:
        # A control string stands in an escaped text only behind a backslash.
        assert not re.search(r"(?:^|[^\\])(?:\\\\)*(?:###|</turn>)", TEMPLATE.escape(content))


def test_other_templates():
    chatml = Template("<|im_start|>", "\n", "<|im_end|>\n", ("<|im_start|>", "<|im_end|>"))
    turns = [("user", "a <|im_end|> b \\"), ("assistant", "<<|im_start|>x\n")]
    assert list(chatml.turns("".join(chatml.turn(r, t)[0] for r, t in turns))) == turns
    with pytest.raises(ValueError):
        list(chatml.turns("free text"))
    with pytest.raises(ValueError):
        Template(controls=("###",))


RECORDS = [
    ({"prompt": "p", "completion": "c", "id": 4, "meta": {"a": [1]}}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "completion": None}, "prompt_completion", [("user", "p")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction_output", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, "instruction_output", [("user", "i"), ("assistant", "o")]),
    ({"context": "c", "question": "q", "answer": 7}, "question_answer", [("user", "c\n\nq"), ("assistant", "7")]),
    ({"messages": [{"role": "human", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message_parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from_value", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "p", "messages": []}, None, None), ({}, None, None), ({"other": 1}, None, None), ([1], None, None), ("x", None, None), (None, None, None),
]


def test_layouts(spark):
    rows = [(n, json.dumps(r), "clash") for n, (r, _, _) in enumerate(RECORDS)] + [(100, "{broken", "clash"), (101, None, "clash"), (None, '{"prompt": "p", "completion": "c"}', "")]
    records = spark.createDataFrame(rows, "id long, record string, role string")
    found = {}
    for r in canonical_turns(records, id_column="id").orderBy("turn").collect():
        found.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    for n, (_, name, turns) in enumerate(RECORDS):
        assert found.get(n, []) == ([(None, None, None)] if name is None else [(name, *t) for t in turns])
    assert found[100] == found[101] == [(None, None, None)] and len(found[None]) == 2
    merged = spark.read.json(records.where("id < 4").select("record").rdd.map(lambda r: r.record))
    structs = canonical_turns(merged.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("record")), id_column="id")
    assert {r.layout for r in structs.collect()} == {"prompt_completion", "prompt_response", "instruction_output"}


def test_layouts_with_one_fingerprint_are_refused():
    with pytest.raises(ValueError):
        registry((*LAYOUTS, Layout("again", (Fields("user", ("prompt",)), Fields("assistant", ("completion",))))))
    with pytest.raises(ValueError):
        registry((Layout("a", (Each("m", "r", "t"),)), Layout("b", (Each("m", "t", "r"),))))


def plain(rows):
    held = {}
    for conversation, turn, role, text in rows:
        if (conversation, turn, role, text) != (None,) * 4:
            held.setdefault(conversation, []).append((turn, role or "", text or ""))
    out = set()
    for conversation, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{t[1]}\n{t[2]}".encode()).hexdigest()))
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        out.add((conversation, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(learnt),
                 hashlib.sha256(learnt.encode()).hexdigest(), sum(len(TEMPLATE.turn(r, t)[0]) for _, r, t in turns)))
    return out


def records_of(spark, rows):
    table = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, task int")
    return table.select(F.struct("conv_id", "turn", "role", "text").alias("record"))


def test_table_rows_against_plain_text(spark, odd_texts):
    rows = [(n % 5, n, ("user", "assistant", "system", None, "a: b")[n % 5 % 3 + n % 3], t) for n, (_, t) in enumerate(odd_texts)]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (8, 1, "assistant", "x"), (8, 1, "assistant", "x"),
             (8, 1, "user", "y"), (8, None, "system", "z"), (None, 1, "assistant", "no id"), (None, None, None, None), (9, None, None, None)]
    assert {tuple(r) for r in chats_digest(records_of(spark, rows)).collect()} == plain(rows)
    assert chats_digest(records_of(spark, rows).where("false")).count() == 0


def test_a_conversation_with_most_rows_is_spread(spark):
    rows = [(1 if n % 3 else n, n, "assistant" if n % 2 else "user", f"text {n} " * (n % 40)) for n in range(6000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        formatted = format_chats(table, part_chars=5000).persist()
        assert formatted.where("conv_id = 1").select("task").distinct().count() >= 4
        assert formatted.agg(F.max(F.length("formatted"))).first()[0] < 6000
        assert {tuple(r) for r in read_back(formatted).collect()} == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
