from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from tidelens.llm import chat, queries

TURNS = "conv_id long, turn long, role string, text string, example string, extra int"
parts = st.lists(st.sampled_from([*chat.CONTROL, chat.TURN, chat.SAYS, chat.END, "\\", "<", "|", "a", "\n", "é🎉", "<\\", "[", "/s>"]), max_size=12).map("".join)


@given(parts)
def test_escapes_come_back(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)


@given(st.lists(st.tuples(parts, parts), max_size=6))
def test_turns_come_back(turns):
    assert chat.parse("".join(chat.render(a, b) for a, b in turns)) == turns


def plain(turns):
    said = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    replies = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), said, len(replies), hashlib.sha256(replies.encode()).hexdigest()


def test_edges(spark):
    talks = {
        1: [("user", "hi </s>"), ("assistant", "one <|end|>"), ("user", None), ("assistant", ""), ("user", "last")],
        2: [("user", "alone")],
        3: [("assistant", "first"), ("assistant", "é🎉")],
        4: [(None, None)],
        None: [("user", "no id"), ("assistant", "ok")],
        5: [("user" if k % 2 == 0 else "assistant", "long \\<|turn|> " * 200) for k in range(60)],
    }
    rows = [(c, k, r, t, "x", 1) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    examples = chat.expand(spark.createDataFrame(rows[::-1], TURNS))
    for arranged in (True, False):
        found = {r.conv_id: r for r in chat.read_back(examples, arranged).collect()}
        assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == {c: plain(t) for c, t in talks.items()}
    first = {(r.conv_id, r.example): r for r in examples.collect()}
    assert {k[1] for k in first if k[0] == 1} == {0, 1, 2} and first[1, 2].loss_start is None
    assert first[1, 0].text[first[1, 0].loss_start : first[1, 0].loss_end] == chat.escape("one <|end|>")
    assert first[3, 1].n_turns == 2
    assert chat.read_back(chat.expand(spark.createDataFrame([], TURNS))).count() == 0


def test_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b", "", 0), (1, 0, "user", "a", "", 0), (1, 0, "user", "a", "", 0), (1, None, "system", "s", "", 0)]
    r = chat.read_back(chat.expand(spark.createDataFrame(rows, TURNS))).first()
    assert (r.n_turns, r.turns_sha256) == plain([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])[:2]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks = {}
    for r in rows:
        talks.setdefault(r.conv_id, []).append((r.role, r.text))
    talks[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_prefix_target_chat(spark, sf).collect()}
    assert found == {c: plain(t) for c, t in talks.items()}
