"""Chat formatting: conversations rendered by a compiled template, with a loss mask, and read back.

The default template writes each turn as `<turn>role`, a line end, the text, `</turn>` and a line end. Control strings
inside roles and texts are escaped with a backslash, and backslashes doubled, so every output can be read back exactly.
The assistant's texts are generated pieces: they alone carry loss.

Turns are shuffled by conversation and sorted; each conversation then streams through the template, so a task holds one
turn at a time, however long the conversation. A digest over a conversation's turns must see them in order, hence one
conversation is one task's work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

from .templates import Template

#: Fixed strings of the default format; `### ` opens a heading in other formats and is escaped with them.
CONTROL = ("<turn>", "</turn>", "### ")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPE_LINE = re.compile("|".join(map(re.escape, ("\\", "\n", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_MARK = re.compile(r"\\.|<turn>|</turn>|\n", re.S)

DEFAULT = (
    "{% for m in messages %}<turn>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)


def escape(text: str | None) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text or "")


def escape_line(text: str | None) -> str:
    return _ESCAPE_LINE.sub(lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def default_template() -> Template:
    return Template(DEFAULT, {"escape": escape, "escape_line": escape_line})


def read_turns(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation that arrives in pieces."""
    held, role, state = "", "", "out"
    for piece in pieces:
        held += piece
        at = start = 0
        while m := _MARK.search(held, at):
            at = m.end()
            if state == "out" and m[0] == "<turn>":
                state, start = "role", at
            elif state == "role" and m[0] == "\n":
                role, state, start = unescape(held[start : m.start()]), "text", at
            elif state == "text" and m[0] == "</turn>":
                yield role, unescape(held[start : m.start()])
                state, start = "out", at
        held = held[start:] if state != "out" else held[at:]
    if state != "out":
        raise ValueError("a turn has no end")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, piece, text, generated): the formatted conversation in pieces, in
    order within a partition; joined by piece number they are the output, and generated ones are under the loss mask.

    Turns go by turn, then role, then text; null turns first, null roles and texts are empty. Rows without a conv_id form
    one conversation. Repeated rows are repeated turns. Other columns are not read; an empty table gives no rows."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    given = template

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = given or default_template()
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "piece", "text", "generated"])

        for conv_id, own in groupby(_rows(batches), key=lambda r: r[0]):
            for number, (text, generated) in enumerate(made.stream({"role": r, "text": t} for _, r, t in own)):
                out.append((conv_id, number, text, generated))
                size += len(text) + 32
                if size > 1 << 22:
                    yield batch()
                    out, size = [], 0
        yield batch()

    return map_arrow(rows, work, "conv_id long, piece long, text string, generated boolean")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    for conv_id, own in groupby(_rows(batches), key=lambda r: r[0]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        counts = {"chars": 0, "loss": 0, "turns": 0}

        def passing(own=own, loss=loss, counts=counts) -> Iterator[str]:
            for _, _, text, generated in own:
                counts["chars"] += len(text)
                if generated:
                    plain = unescape(text)
                    counts["loss"] += len(plain)
                    loss.update(plain.encode())
                yield text

        for role, text in read_turns(passing()):
            counts["turns"] += 1
            turns.update(f"{role}\n{text}\n".encode())
        found.append((conv_id, counts["turns"], turns.hexdigest(), counts["loss"], loss.hexdigest(), counts["chars"]))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)


def conversation_digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Format the conversations, read them back, and return per conversation: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Cases as in format_conversations; the template must write turns as the default does."""
    return map_arrow(format_conversations(turns, template), _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
