"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word, the bytes from ``begin`` to ``end``.

    A word is read in blocks of eight bytes.  Each block is mixed with its place and the mixed blocks are
    added, so no structure of the word's letters survives into the sum; the length is mixed in at last.
    """
    length = end - begin
    blocks = (length + 7) >> 3
    word_of = np.repeat(np.arange(len(begin)), blocks)
    first = np.cumsum(blocks) - blocks
    nth = np.arange(len(word_of)) - first[word_of]
    at = begin[word_of] + 8 * nth
    padded = np.concatenate([_LOWER[data], np.zeros(8, dtype=np.uint8)])
    value = np.zeros(len(at), dtype=_U)
    for k in range(8):
        value |= padded[at + k].astype(_U) << _U(8 * k)
    kept = np.minimum(length[word_of] - 8 * nth, 8).astype(_U)
    value &= ~_U(0) >> (_U(64) - (kept << _U(3)))
    mixed = mix(mix(value ^ _U(0xD6E8FEB86659FD93)) + mix(nth.astype(_U) + _U(0xCA9B0C7EBA1DA115)))
    return mix(np.add.reduceat(mixed, first) + length.astype(_U) * _U(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text (UTF-8); none for null or wordless texts.

    Words are runs of bytes other than space and 0x09 to 0x0D, with A to Z in lower case.  A text of
    fewer words than a shingle has its whole sequence as one.
    """
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    empty = np.zeros(0, dtype=_U)
    if not len(data):
        return [empty] * n
    inner = ~_SEPARATOR[data]
    first, last = inner.copy(), inner.copy()
    starts_at = np.zeros(len(data) + 1, dtype=bool)
    starts_at[offsets] = True
    first[1:] &= ~inner[:-1] | starts_at[1:-1]
    last[:-1] &= ~inner[1:] | starts_at[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begin):
        return [empty] * n
    word = _word_hashes(data, begin, end)
    bounds = np.searchsorted(begin, offsets)
    joined = np.zeros(max(0, len(word) - words + 1), dtype=_U)
    for k in range(words):
        joined += mix(word[k : k + len(joined)] + _U(k + 1))
    joined = mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            short = _U(0)
            for k in range(b - a):
                short = short + mix(word[a + k : a + k + 1] + _U(k + 1))
            out.append(mix(short ^ _U(b - a)))
        else:
            out.append(empty)
    return out


def digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers: a sum over its mixed elements each."""
    halves = []
    for seed in (0, 0x8CB92BA72F3D8DD7):
        total = mix(items + _U(seed)).sum(dtype=_U) if len(items) else _U(0)
        halves.append(int(mix(np.array([total ^ _U((len(items) * 0x9E3779B97F4A7C15 + seed) % 2**64)], dtype=_U)).astype(np.int64)[0]))
    return halves[0], halves[1]
