"""PartEnum signatures for set-similarity joins.

Two sets of Jaccard similarity at least ``num / den`` and sizes of at most ``u`` differ in at most
``k = 2 u (den - num) / (den + num)`` elements.  The domain of elements is hashed into ``n1``
partitions, each into ``PARTS`` parts; a signature is the content of a partition without one of its
parts.  As there are more partitions than ``k / 2``, some hold at most one difference, and leaving
out the part that holds it makes the contents equal: the two sets share a signature.

Sizes are cut into bands whose ends are in the ratio ``(num / den)^2``.  An instance handles the pairs
whose larger set lies in its band; a set takes part in its own band's instance and, if it is large
enough to be the smaller one there, in the next.

Empty contents would be shared by many unlike sets.  There are ``spare`` partitions more than needed,
so at least ``spare + 1`` hold at most one difference, and a set of which at most ``spare`` partitions
have an empty content leaves those out.  Sets with more of them ("weak", which is rare) keep them,
marked; a pair is found by another signature unless both are weak, and then by the marked ones.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .shingles import mix

#: Parts of a partition; a signature leaves out one.
PARTS = 3
_U = np.uint64


@cache
def bands(num: int, den: int, most: int) -> list[int]:
    """Smallest sizes of the bands, up to the first beyond ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * den * den // (num * num) + 1)
    return edges


def instances(size: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(number, partitions, spare) of the instances that a set of ``size`` takes part in."""
    top = 1 << max(10, size.bit_length() + 1)
    edges = bands(num, den, top)
    own = int(np.searchsorted(edges, size, side="right")) - 1
    numbers = [own] + [own + 1] * (size * den >= edges[own + 1] * num)
    out = []
    for i in numbers:
        differences = 2 * (edges[i + 1] - 1) * (den - num) // (den + num)
        if differences:  # else only equal sets are similar
            needed = differences // 2 + 1
            out.append((i, needed + needed // 6, needed // 6))
    return out


def signatures(items: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of a set of 64-bit hashes, as 64-bit words."""
    out = []
    low, high = (items & _U(0xFFFFFFFF)).astype(np.float64), (items >> _U(32)).astype(np.float64)
    for number, partitions, spare in instances(len(items), num, den):
        place = mix(items + _U((number + 1) * 0xD1342543DE82EF95 % 2**64))
        cell = ((place >> _U(20)) % _U(partitions * PARTS)).astype(np.int64)
        n = partitions * PARTS
        # sums of halves are exact in doubles, as a set has fewer than 2^21 elements in a cell
        content = np.bincount(cell, low, n).astype(_U) + np.bincount(cell, high, n).astype(_U) * _U(0x9E3779B97F4A7C15)
        count = np.bincount(cell, minlength=n)
        content, count = content.reshape(partitions, PARTS), count.reshape(partitions, PARTS)
        rest = content.sum(axis=1, dtype=_U, keepdims=True) - content
        left = count.sum(axis=1, keepdims=True) - count
        marks = mix(np.arange(n, dtype=_U) + _U(number << 32)).reshape(partitions, PARTS)
        signs = mix(rest * _U(0xA24BAED4963EE407) ^ marks)
        empty = left == 0
        if empty.any(axis=1).sum() > spare:
            signs[empty] = mix(signs[empty] ^ _U(0x5851F42D4C957F2D))
            out.append(signs.ravel())
        else:
            out.append(signs[~empty])
    return np.concatenate(out) if out else np.zeros(0, dtype=_U)
