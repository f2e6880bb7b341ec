"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of every whole text; where its top bits are zero, a chunk ends.  The
hash depends on the last 16 bytes only, so an insertion moves the chunks after it but does not change
them, and a passage that two texts share falls into the same chunks in both.  Where no place ends a
chunk for long, as in a word said over and over, it ends at the least hash, which also depends on the
content only.  Chunks are compared by
a 128-bit digest: the first occurrence of a digest (smallest document, then place) stays, all later
ones are repeats, and adjacent repeats form a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hub_join, kept
from .shingles import _SEPARATOR, mix

#: Bytes that the rolling hash looks back on; the width of its words in bits.
WINDOW = 16
#: One in 2^CUT_BITS places ends a chunk; the least and the greatest length of a chunk in bytes.
CUT_BITS, LEAST, GREATEST = 5, 16, 128
#: Words of adjacent repeated chunks from which they count as a repeated passage, or bytes, for text without spaces.
#: A passage shares its first and its last chunk with other text, so of 50 words about 30 to 45 are found, and fewer
#: where words are said over and over.
MIN_WORDS, MIN_BYTES = 20, 400

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash ``h = 2 h + gear[byte]`` (modulo 2^16) after each byte.

    A word's value is the shifted sum of the last 16 bytes, summed here in four doubling steps.
    """
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    hashes = gear_hashes(data)
    places = np.flatnonzero(hashes < (1 << (WINDOW - CUT_BITS))) + 1
    ends, start, n = [], 0, len(data)
    for p in [*places[places >= WINDOW].tolist(), n]:
        while p - start > GREATEST:  # the first place of the least hash ends a chunk
            start += LEAST + int(hashes[start + LEAST - 1 : start + GREATEST].argmin())
            ends.append(start)
        if p - start >= LEAST or p == n > start:
            ends.append(p)
            start = p
    return ends


def word_starts(data: np.ndarray) -> np.ndarray:
    """The number of words that begin before each byte and at the end."""
    inner = ~_SEPARATOR[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    return np.concatenate([[0], np.cumsum(first)])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, start, size, words, d1, d2): the chunks of every text, in bytes of its UTF-8, and their digests."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, words, digests = [], [], [], [], []

            def full(batch: pa.RecordBatch = batch, rows: list = rows, starts: list = starts, ends: list = ends, words: list = words, digests: list = digests) -> pa.RecordBatch:
                begin, end = np.concatenate(starts), np.concatenate(ends)
                halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat([r for r, _ in rows], [n for _, n in rows]))),
                        pa.array(begin),
                        pa.array((end - begin).astype(np.int32)),
                        pa.array(np.concatenate(words).astype(np.int32)),
                        pa.array(halves[:, 0].copy()),
                        pa.array(halves[:, 1].copy()),
                    ],
                    names=["_id", "start", "size", "words", "d1", "d2"],
                )
                for each in (rows, starts, ends, words, digests):
                    each.clear()
                return out

            for row, text in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = text.as_py()
                if not raw:
                    continue
                data = np.frombuffer(raw, dtype=np.uint8)
                cuts = chunk_ends(data)
                begins = [0, *cuts[:-1]]
                before = word_starts(data)
                words.append(before[cuts] - before[begins])
                rows.append((row, len(cuts)))
                starts.append(np.array(begins, dtype=np.int64))
                ends.append(np.array(cuts, dtype=np.int64))
                digests.extend(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins, cuts, strict=True))
                if len(digests) >= 50_000:
                    yield full()
            if rows:
                yield full()

    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id IS NOT NULL")
    return chosen.mapInArrow(run, f"_id {id_type}, start long, size int, words int, d1 long, d2 long")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, within: bool = False
) -> DataFrame:
    """Spans of at least ``min_words`` words or ``min_bytes`` bytes whose chunks all occurred in an earlier document.

    With ``within``, earlier places of the same document count, too.

    Returns the id, ``first_id`` (the smallest document that a chunk of the span occurred in first),
    ``start`` and ``length`` in bytes of the text's UTF-8, ``n_words`` (that begin in the span) and
    ``n_chunks``.  The first occurrence of a chunk is in no span by it, so removing all spans keeps one
    copy of everything.  The texts are cut once; the chunks are written to the shared folder.

    Occurrences of a digest are counted before the shuffle, and the join that finds them again splits
    chunks that are very frequent.

    Cases: null and empty texts have no chunks and shorter texts no spans; exact copies are one span from start to end; rows that repeat with one id
    stand for one document and give their spans once, and rows with a null id are left out; an empty
    table gives an empty result; other columns, whatever their names, are ignored.
    """
    every, _ = kept(chunks(docs, id_col, text_col), "chunks")
    least = [F.min("_id").alias("first_id"), F.max("_id").alias("last_id"), F.count(F.lit(1)).alias("n")]
    first = every.groupBy("d1", "d2").agg(*least, *([F.min(F.struct("_id", "start")).alias("first")] if within else []))
    first, _ = kept(first.where("n > 1" if within else "first_id < last_id").drop("last_id"), "chunks")
    again = hub_join(every, first.drop("n"), ["d1", "d2"], ["_id", "start"], first)
    again = again.where((F.col("first._id") != F.col("_id")) | (F.col("first.start") != F.col("start")) if within else F.col("first_id") != F.col("_id"))
    again = again.select("_id", "start", "size", "words", "first_id").dropDuplicates(["_id", "start"])
    by_place = Window.partitionBy("_id").orderBy("start")
    joined = F.lag(F.col("start") + F.col("size")).over(by_place) == F.col("start")
    again = again.withColumn("new", F.when(joined, 0).otherwise(1))
    again = again.withColumn("span", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = again.groupBy("_id", "span").agg(
        F.min("first_id").alias("first_id"),
        F.min("start").alias("start"),
        F.sum("size").cast("long").alias("length"),
        F.sum("words").cast("long").alias("n_words"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    long = (F.col("n_words") >= min_words) | (F.col("length") >= min_bytes)
    return spans.where(long).select(F.col("_id").alias(id_col), "first_id", "start", "length", "n_words", "n_chunks")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the ``spans`` (as of ``repeated_spans``) cut out of their texts; all columns stay.

    A character whose bytes two chunks share is cut with the span that holds its first byte.
    """
    own = {c.lower() for c in docs.columns}
    extra = next(f"_{k}" for k in range(len(own) + 1) if not any(c.startswith(f"_{k}") for c in own))
    cut_id, cut = f"{extra}id", f"{extra}cuts"
    cuts = spans.groupBy(F.col(id_col).alias(cut_id)).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(cut))
    joined = docs.join(cuts, docs[id_col] == cuts[cut_id], "left").drop(cut_id)
    names, at = docs.columns, docs.columns.index(text_col)
    last = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                if text is None or not cut:
                    out.append(text)
                    continue
                raw, place, parts = text.encode(), 0, []
                for c in cut:
                    begin, end = (_boundary(raw, x) for x in (c["start"], c["start"] + c["length"]))
                    parts.append(raw[place:begin])
                    place = end
                out.append(b"".join([*parts, raw[place:]]).decode())
            columns = batch.columns[:last]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def _boundary(raw: bytes, at: int) -> int:
    """The next place at or after ``at`` that is not inside a character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at
