"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import text_rows

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Beginnings of control strings, of this template and of common tokenizers. In each, the first character stands only
#: at the beginning, so that their places in a text never overlap.
CONTROL = ("<|", "<s>", "</s>", "<pad>", "<unk>", "<SYS>", "[INST]", "[/INST]")
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_TURNS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.DOTALL)
#: A batch of examples is handed on once it holds so many characters.
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    """One more backslash after the first character of each control string, so that none is left; unescape() takes it
    away again."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


def render(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{SAYS}{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted example: role and text."""
    return [(unescape(a), unescape(b)) for a, b in _TURNS.findall(formatted)]


_EXAMPLES = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.int64(), pa.int64())


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _expand(batches: Iterator[pa.RecordBatch], trained: str) -> Iterator[pa.RecordBatch]:
    names = tuple(x.split(" ")[0] for x in _EXAMPLES.split(", "))
    kinds = tuple(pa.string() if k == pa.large_string() else k for k in _KINDS)
    out: list[tuple] = []
    held, begun, now = 0, False, None
    said: list[str] = []
    turns = example = 0
    open_end = False  # turns after the last reply that no example holds yet

    def finish() -> None:
        nonlocal held
        if open_end:
            out.append((now, example, turns, "".join(said), None, None))
            held += len(out[-1][3])

    for batch in batches:
        for conv, role, text in zip(batch.column(0).to_pylist(), text_rows(batch.column(1)), text_rows(batch.column(2)), strict=True):
            if not begun or conv != now:
                finish()
                begun, now, said, turns, example, open_end = True, conv, [], 0, 0, False
            said.append(render(role or "", text or ""))
            turns, open_end = turns + 1, True
            if role == trained:
                said = ["".join(said)]
                whole = said[0]
                end = len(whole) - len(END)
                out.append((now, example, turns, whole, end - len(escape(text or "")), end))
                held, example, open_end = held + len(whole), example + 1, False
            if held >= BATCH_CHARS:
                yield _batch(out, names, kinds)
                out, held = [], 0
    finish()
    if out:
        yield _batch(out, names, kinds)


def expand(df: DataFrame, trained: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn of role `trained`: all turns up to it, formatted, with the place of its text as loss span.

    Columns: conv_id, example (from 0), n_turns (in the example), text, loss_start and loss_end (code points, end
    exclusive). Turns after the last reply, and conversations without one, give a last example with no loss span, so
    the examples together hold every turn. Replies inside the context are not trained on.

    Turns are ordered by turn, then role and text where turns tie; a null turn comes first. A null role or text is
    empty. Rows with a null conv_id form a conversation of their own; repeated rows are repeated turns. Columns other
    than the four named are left out; an empty table gives no example.

    A conversation's turns come to one task, in order, and stream through it: it holds the turns so far of one
    conversation and a batch of examples. The text of all examples grows with the square of a conversation's length;
    that is what the expansion means.
    """
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(turn).alias("turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(lambda batches: _expand(batches, trained), _EXAMPLES)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = tuple(x.split(" ")[0] for x in _READ.split(", "))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    last: tuple | None = None
    loss, chars, all_chars, examples = hashlib.sha256(), 0, 0, 0

    def row() -> tuple:
        turns = parse(last[1])
        said = hashlib.sha256()
        for role, text in turns:
            said.update(f"{role}\n{text}\n".encode())
        return (last[0], len(turns), said.hexdigest(), chars, loss.hexdigest(), all_chars, examples)

    for batch in batches:
        out = []
        for conv, text, start, end in zip(batch.column(0).to_pylist(), text_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if last is not None and last[0] != conv:
                out.append(row())
                loss, chars, all_chars, examples = hashlib.sha256(), 0, 0, 0
            last = (conv, text)
            all_chars, examples = all_chars + len(text), examples + 1
            if start is not None:
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                chars += len(reply)
        if out:
            yield _batch(out, names, kinds)
    if last is not None:
        yield _batch([row()], names, kinds)


def read_back(examples: DataFrame, arranged: bool = False) -> DataFrame:
    """What the formatted examples say, by conversation: the turns of its last example, and the text under all loss
    spans in order. arranged: the rows are as expand() returns them, a conversation's together and in order; if not,
    they are brought together here. An empty table gives none."""
    rows = examples.select("conv_id", "text", "loss_start", "loss_end", "example")
    if not arranged:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return rows.drop("example").mapInArrow(_read, _READ)
