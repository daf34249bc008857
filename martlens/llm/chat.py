"""Chat formatting with compiled templates, and the reading back of formatted conversations."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import compile_template

#: Every turn: its role, then its text; the text of assistant turns is under the loss mask.
TEMPLATE = "{% for m in messages %}<s>{{ m.role | escape }}[INST]{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}[/INST]</s>{% endfor %}"
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)


def escape(text: str | None) -> str:
    """A backslash goes into every control string, and one more into what looks like an escaped one; null is empty."""
    return _CONTROL.sub(r"\1\\\2\3", text or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def read_turns(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss mask, formatted characters) of each turn, read from formatted output; holds one turn at a time."""
    held, masked = "", []
    for text, marked in pieces:
        if marked:
            masked.append(text)
        held += text
        while held.endswith("</s>") and (m := _TURN.match(held)):
            yield unescape(m[1]), unescape(m[2]), "".join(map(unescape, masked)), m.end()
            held, masked = held[m.end() :], []
    if held:
        raise ValueError("formatted output ends within a turn")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("i", pa.int32()), ("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32())])


def _format_rows(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        for conv, turns in itertools.groupby(_rows(batches), key=lambda r: r["conv_id"]):
            for i, turn in enumerate(_formatted_turns(render, turns)):
                yield pa.RecordBatch.from_pylist([dict(zip(_FORMATTED.names, (conv, i, *turn), strict=True))], _FORMATTED)

    return run


def _formatted_turns(render, turns: Iterable[dict]) -> Iterator[tuple[str, int | None, int | None]]:
    held, start, end = "", None, None
    for text, marked in render({"messages": turns}):
        if marked and start is None:
            start = len(held)
        held += text
        if marked:
            end = len(held)
        if held.endswith("</s>") and _TURN.fullmatch(held):
            yield held, start, end
            held, start, end = "", None, None


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted text as rows (conv_id, i, formatted, loss_from, loss_to), one for each turn in order.

    The formatted conversation is its rows' texts put together; loss_from and loss_to are the code points under the loss
    mask. Turns with equal numbers follow by role and text; null role or text is empty; rows without conv_id are one
    conversation. Other columns are ignored; an empty table gives an empty result.
    """
    return _sorted(conversations).mapInArrow(_format_rows(template), "conv_id long, i int, formatted string, loss_from int, loss_to int")


def _digest_rows(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        out = []
        for conv, turns in itertools.groupby(_rows(batches), key=lambda r: r["conv_id"]):
            whole, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, masked, length in read_turns(render({"messages": turns})):
                whole.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + length
            out.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


_DIGESTS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGESTS.values(), strict=True)], list(_DIGESTS))


def conversation_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted output.

    Turns stream through a task one at a time, so a conversation may be longer than memory. Rules as in
    format_conversations.
    """
    return _sorted(conversations).mapInArrow(_digest_rows(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
