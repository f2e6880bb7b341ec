"""Formatting conversations with a chat template and reading the result back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .chat_template import Piece, compile_template, unescape
from .common import shuffle_width

START, END = "<|im_start|>", "<|im_end|>"
#: Characters of formatted conversations that are returned together.
BATCH_CHARS = 4_000_000
#: Turns between control strings; the assistant's texts are what a model learns.
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}{{ m.text }}{% endif %}"
    "<|im_end|>\n{% if loop.last and add_generation_prompt %}<|im_start|>assistant\n{% endif %}{% endfor %}"
)


def read_turns(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, list[str]]]:
    """(role, text, generated texts) of each turn of a formatted conversation, unescaped.

    The text is read as a stream; at most one turn is held.
    """
    held, generated = "", []
    inside = False
    for text, learned in pieces:
        if learned:
            if inside:
                generated[-1] += text
            else:
                generated.append(text)
        inside = learned
        held += text
        while not learned and (end := held.find(END)) >= 0:
            begin = held.index(START) + len(START)
            role, _, body = held[begin:end].partition("\n")
            yield json.loads(f'"{unescape(role)}"'), unescape(body), [unescape(g) for g in generated]
            held, generated = held[end + len(END) :], []


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True)


def _conversations(batches: Iterator[pa.RecordBatch], write: Callable, prompt: bool) -> Iterator[tuple]:
    """(conv_id, pieces) of each conversation; the pieces are made as they are read."""
    for conv_id, rows in groupby(_stream(batches), key=lambda r: r[0]):
        messages = ({"role": role or "", "text": text or "", "content": text or ""} for _, role, text in rows)
        yield conv_id, write({"messages": messages, "add_generation_prompt": prompt})


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, add_generation_prompt: bool = False) -> DataFrame:
    """Render every conversation of (conv_id, turn, role, text) with ``template``.

    The template sees ``messages``, with ``role``, ``text`` and ``content`` (the same) of each, and
    ``add_generation_prompt``.
    Returns conv_id, ``formatted`` (the text) and ``spans`` (array of ``start``, ``end`` in code points:
    what is marked as generated).

    Cases: rows are taken by turn, ties by role, then text, nulls first; rows that repeat are turns of
    their own; null roles and texts are empty; a null conv_id is a conversation; other columns are
    ignored; an empty table gives an empty result.
    """
    compile_template(template)  # a wrong template fails at once
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    id_arrow = to_arrow_type(conversations.schema["conv_id"].dataType)
    schema = f"conv_id {id_type}, formatted string, spans array<struct<start: long, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        rows: list[tuple] = []
        held = 0

        def full() -> pa.RecordBatch:
            ids, texts, marks = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(texts), pa.array(marks, kind)], names=["conv_id", "formatted", "spans"])

        for conv_id, pieces in _conversations(batches, compile_template(template), add_generation_prompt):
            parts, spans, place = [], [], 0
            for text, learned in pieces:
                if learned and text:
                    if spans and spans[-1]["end"] == place:
                        spans[-1]["end"] += len(text)
                    else:
                        spans.append({"start": place, "end": place + len(text)})
                parts.append(text)
                place += len(text)
            rows.append((conv_id, "".join(parts), spans))
            held += place
            if held >= BATCH_CHARS or len(rows) >= 1000:
                yield full()
                held = 0
        if rows:
            yield full()

    return _sorted_turns(conversations).mapInArrow(run, schema)


def conversation_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Format every conversation and read the turns and the generated texts back from the output.

    Returns conv_id, n_turns, turns_sha256 (of role, line end, text, line end for each turn),
    loss_chars, loss_sha256 (of the generated texts, unescaped) and formatted_chars.  Conversations
    pass as a stream, so the memory needed is that of one turn however long a conversation is.
    Cases: as of ``format_conversations``.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    id_arrow = to_arrow_type(conversations.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def measured(pieces: Iterator[Piece], size: list[int]) -> Iterator[Piece]:
        for piece in pieces:
            size[0] += len(piece[0])
            yield piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def full() -> pa.RecordBatch:
            ids, *rest = zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), *map(pa.array, rest)], names=names)
            rows.clear()
            return out

        for conv_id, pieces in _conversations(batches, compile_template(template), False):
            size, turns, chars = [0], 0, 0
            of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
            for role, text, learned in read_turns(measured(pieces, size)):
                turns += 1
                of_turns.update(f"{role}\n{text}\n".encode())
                for part in learned:
                    chars += len(part)
                    of_loss.update(part.encode())
            rows.append((conv_id, turns, of_turns.hexdigest(), chars, of_loss.hexdigest(), size[0]))
            if len(rows) >= 1000:
                yield full()
        if rows:
            yield full()

    compile_template(template)  # a wrong template fails at once
    return _sorted_turns(conversations).mapInArrow(run, schema)
