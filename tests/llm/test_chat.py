"""Layouts, template and digests of conversations."""

from __future__ import annotations

import json
from collections import defaultdict

from hypothesis import given, strategies as st

from lingweave.llm import chat
from tests.llm import brute

ODD = st.lists(st.sampled_from([*"\\#</>turn: \nab中👅", "###", "</turn>", "### assistant: "]), max_size=15).map("".join)


@given(st.lists(st.tuples(ODD, ODD), max_size=5))
def test_template_reads_back(turns):
    made = [chat.render(*t) for t in turns]
    assert list(chat.parse("".join(m[0] for m in made))) == turns
    for (role, text), (formatted, start, end) in zip(turns, made):
        assert chat.unescape(formatted[start:end]) == (text if role == "assistant" else "")


def test_layouts(spark):
    records = {
        1: {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 5},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "meta": {"x": [1]}},
        3: {"prompt": "q", "response": "a", "source": "z"},
        4: {"instruction": "do", "input": "this", "output": "done"},
        5: {"instruction": "do", "input": "", "output": "done"},
        6: {"system": "s", "instruction": "do", "input": None, "output": "done"},
        7: {"question": "q", "answer": "a"},
        8: {"turn": 3, "role": "user", "text": "q"},
        9: {"unknown": 1},
        10: [1, 2],
        11: {"messages": []},
        14: {"instruction": "do", "output": "done", "turn": "x"},
        15: {"messages": [{"role": "human", "content": "q", "name": "n"}, "loose", {"role": "gpt", "tool_calls": [{"f": 1}]}]},
        16: {"prompt": 5, "response": {"a": [True, None]}, "system": "s"},
        17: {"messages": "text"},
        18: {"messages": ["a", "b"]},
        19: {"role": "gpt", "text": "kept as it is", "turn": 1 << 70, "score": 0.5},
        20: {"question": "\ud800q", "answer": None, "unknown": {"x": 1}},
        21: {},
    }
    rows = [(i, json.dumps(r), 1, "x") for i, r in records.items()]
    rows += [(12, None, 1, "x"), (13, "{broken", 1, "x"), (22, '{"a":' + "[" * 100_000, 1, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, record string, part int, other string")
    got, without = defaultdict(list), {}
    turns = chat.canonical_turns(frame)
    for r in turns.orderBy("conv_id", "part").collect():
        assert r.other == "x" and (r.turn is None or r.conv_id == 8)
        if r.part is None:
            assert (r.role, r.text) == (None, None)
            without[r.conv_id] = r.layout
        else:
            got[r.conv_id].append((r.role, r.text))
    assert without == {9: None, 10: None, 11: "messages", 12: None, 13: None, 17: None, 18: None, 21: None, 22: None}
    counts = {r.conv_id: (r.n_turns, r.formatted_chars > 0) for r in chat.digests(chat.format_turns(turns)).collect()}
    assert counts == {**{i: (len(t), True) for i, t in got.items()}, **{i: (0, False) for i in without}}
    assert got == {
        1: [("system", "s"), ("user", "q"), ("assistant", "")],
        2: [("user", "q"), ("assistant", "a")],
        3: [("user", "q"), ("assistant", "a")],
        4: [("user", "do\n\nthis"), ("assistant", "done")],
        5: [("user", "do"), ("assistant", "done")],
        6: [("system", "s"), ("user", "do"), ("assistant", "done")],
        7: [("user", "q"), ("assistant", "a")],
        8: [("user", "q")],
        14: [("user", "do"), ("assistant", "done")],
        15: [("user", "q"), ("", "loose"), ("assistant", "")],
        16: [("system", "s"), ("user", "5"), ("assistant", '{"a": [true, null]}')],
        19: [("gpt", "kept as it is")],
        20: [("user", "\ufffdq"), ("assistant", "")],
    }


def test_fingerprints_are_distinct_and_ignore_values():
    prints = [chat.fingerprint(v) for x in chat.LAYOUTS for v in x.variants()]
    assert len(set(prints)) == len(prints) > len(chat.LAYOUTS)
    a = {"messages": [{"role": "x", "content": 1}, {"content": None, "role": "y"}]}
    b = {"messages": [{"content": "z", "role": None}], "id": "m"}
    assert chat.fingerprint(chat.content_paths(a)) == chat.fingerprint(chat.content_paths(b))


def test_digests(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", "hi"), (1, 2, "assistant", "b"), (1, 1, "assistant", "a" * 100_000), (1, 1, "assistant", "a" * 100_000),
        (2, 0, None, None), (2, None, "user", "first"), (None, 0, "assistant", said), (3, 0, "assistant", said), (3, 0, "user", said),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat.format_turns(chat.canonical_turns(chat.conversations(frame)))
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha256(loss))
        assert r.formatted_chars == sum(len(chat.render(r, t)[0]) for _, _, r, t in turns)
    assert chat.digests(formatted.where("false")).count() == 0
