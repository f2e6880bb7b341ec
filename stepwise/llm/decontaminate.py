"""Benchmark decontamination by pigeonhole edit matching.

An item of the benchmark with an error budget of ``k`` edits is cut into ``k + 1`` pieces.  Wherever
a text comes within ``k`` edits of the item, at least one piece survives unchanged.  An Aho-Corasick
automaton finds all exact pieces in one pass over the whole text, and around each find Myers'
bit-parallel algorithm computes the least edit distance between the item and any stretch of the
text.  The method loses no match within the budget.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each hundred characters of a normalised item.
ERRORS_PERCENT = 6
#: Items are dealt into blocks of about so many characters; a process keeps the automata of so many, a few dozen bytes for
#: each.  Where there are more items, texts of so many bytes at a time meet one block after the other.
BLOCK_CHARS, KEPT_CHARS, CHUNK_BYTES = 1_000_000, 4_000_000, 32_000_000

_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, with every run of characters that are neither letters nor digits as one space."""
    return _GAPS.sub(" ", text.lower()).strip(" ") if text else ""


def budget(item: str, percent: int = ERRORS_PERCENT) -> int:
    return len(item) * percent // 100


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """Cut the item into ``errors + 1`` pieces of nearly equal length, with their offsets."""
    ends = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def best_match(item: str, text: str, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of ``item`` to a substring of ``text`` and where the first such one ends.

    Myers' algorithm: the vertical differences of a column of the edit table are two bit vectors,
    and one character of the text moves to the next column.
    """
    if peq is None:
        peq = character_masks(item)
    n = len(item)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, distance = mask, 0, n
    best, end = n, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | (mask & ~(horizontal | plus))
        h_minus = plus & horizontal
        if h_plus & top:
            distance += 1
        elif h_minus & top:
            distance -= 1
        h_plus = (h_plus << 1) & mask
        h_minus = (h_minus << 1) & mask
        plus = h_minus | (mask & ~(vertical | h_plus))
        minus = h_plus & vertical
        if distance < best:
            best, end = distance, at
    return best, end


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], percent: int = ERRORS_PERCENT) -> None:
        self.items, self.percent = items, percent
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item, budget(item, self.percent)):
                places.setdefault(piece, []).append((k, offset))
        self.parts = ahocorasick.Automaton()
        for piece, where in places.items():
            self.parts.add_word(piece, (len(piece), where))
        self.parts.make_automaton()
        self.masks = [character_masks(item) for _, item in self.items]

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """Of each item (by its place) within its budget: the least distance and where it ends."""
        found: dict[int, tuple[int, int]] = {}
        looked: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.parts.iter(text):
            for k, offset in where:
                if k in found and found[k][0] == 0:
                    continue
                item = self.items[k][1]
                start = end + 1 - size - offset
                if start >= 0 and text.startswith(item, start):
                    found[k] = 0, start + len(item)
                    continue
                errors = budget(item, self.percent)
                if errors == 0:
                    continue
                low, high = max(0, start - errors), min(len(text), start + len(item) + errors)
                if any(a <= low and high <= b for a, b in looked.get(k, ())):
                    continue  # an earlier find led to the same place
                looked.setdefault(k, []).append((low, high))
                distance, at = best_match(item, text[low:high], self.masks[k])
                if distance <= errors and (k not in found or distance < found[k][0]):
                    found[k] = distance, low + at
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of bounded size, read one after the other."""
    block: list[tuple[int, str]] = []
    chars = 0
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).distinct()
    for item_id, text in rows.orderBy(id_col, text_col).toLocalIterator():
        item = normalise(text)
        if item:
            block.append((item_id, item))
            chars += len(item)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


#: Automata of this process, by block, the one used last at the end.
_BUILT: dict[str, tuple[int, Matcher]] = {}


class Benchmark:
    """The items in blocks, which are broadcast compressed, and built into automata once in a process."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, percent: int) -> None:
        context = items.sparkSession.sparkContext
        self.percent, self.blocks = percent, []
        for block in item_blocks(items, id_col, text_col):
            sent = context.broadcast(zlib.compress(pickle.dumps(block)))
            self.blocks.append((f"{uuid.uuid4().hex}", sum(len(item) for _, item in block), sent))

    def matcher(self, number: int) -> Matcher:
        key, chars, sent = self.blocks[number]
        held = _BUILT.pop(key, None) or (chars, Matcher(pickle.loads(zlib.decompress(sent.value)), self.percent))
        while _BUILT and chars + sum(n for n, _ in _BUILT.values()) > KEPT_CHARS:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = held
        return held[1]

    def find(self, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        """Each batch with the (item id, distance, length, end) that the text of each row, column ``at``, holds.

        The texts pass once.  If a process cannot keep all automata, texts are gathered before they meet
        the blocks, so that an automaton is built for many.
        """
        together = CHUNK_BYTES if sum(n for _, n, _ in self.blocks) > KEPT_CHARS else 0
        chunk, size = [], 0
        for batch in batches:
            for part in self._parts(batch, together):
                chunk.append(part)
                size += part.nbytes
                if size >= together:
                    yield from self._met(chunk, at)
                    chunk, size = [], 0
        if chunk:
            yield from self._met(chunk, at)

    @staticmethod
    def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
        rows = batch.num_rows if not most else max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, max(1, rows)):
            yield batch.slice(at, rows)

    def _met(self, chunk: list[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        texts = [[normalise(text.as_py()) for text in part.column(at)] for part in chunk]
        hits: list[list[list[tuple]]] = [[[] for _ in part] for part in texts]
        for number in range(len(self.blocks)):
            matcher = self.matcher(number)
            for part, into in zip(texts, hits, strict=True):
                for text, row in zip(part, into, strict=True):
                    row += [(matcher.items[k][0], d, len(matcher.items[k][1]), end) for k, (d, end) in matcher.find(text).items()]
        yield from zip(chunk, hits, strict=True)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = ERRORS_PERCENT,
) -> DataFrame:
    """Every pair of a document and an item that its text holds within the error budget.

    Returns the document's id, ``item_id``, ``distance`` (edits in normalised text), ``item_chars``
    (length of the normalised item) and ``match_end`` (in the normalised text, the best match's end).

    Cases: null or empty texts and texts shorter than the item less its budget hold nothing; null,
    empty or letterless items are ignored; of items with one text each id is reported; repeated
    documents are reported row by row; an item under ``100 / percent`` characters must occur exactly;
    an empty table gives an empty result.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id_col].dataType.simpleString()}, distance int, item_chars int, match_end long"
    id_type = items.schema[item_id_col].dataType
    chosen = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("_text"))
    benchmark = Benchmark(items, item_id_col, item_text_col, percent)
    item_type = pa.string() if id_type.simpleString() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in benchmark.find(batches, 1):
            hits = [(row, *hit) for row, of_row in enumerate(found) for hit in of_row]
            if hits:
                rows, ids, distances, sizes, ends = zip(*hits, strict=True)
                columns = [pa.array(ids, item_type), pa.array(distances, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ends, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=[id_col, "item_id", "distance", "item_chars", "match_end"])

    return chosen.mapInArrow(run, schema)


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = ERRORS_PERCENT,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns, in one pass."""
    at = docs.columns.index(text_col)
    benchmark = Benchmark(items, item_id_col, item_text_col, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in benchmark.find(batches, at):
            yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
