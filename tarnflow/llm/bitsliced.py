"""Bit-sliced Hamming comparison: bit planes stored vertically, 64 comparisons a machine word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes between two looks at which words can be abandoned.
_LOOK = 8


def within(plane: Callable[[int, np.ndarray | None], np.ndarray], words: int, bits: int, radius: int) -> np.ndarray:
    """Of ``words`` words of 64 comparisons each: a bit set where at most ``radius`` of ``bits`` planes differ.

    ``plane(p, live)`` gives plane p of the differences at the words ``live`` (None: all). Vertical counters start so far
    up that they overflow at radius + 1; two planes at a time enter by a carry-save adder. A word is abandoned once all
    its 64 comparisons have overflowed."""
    k = max(1, radius.bit_length())
    start = (1 << k) - 1 - radius
    counters = [np.full(words, _ONES if start >> i & 1 else 0, np.uint64) for i in range(k)]
    over, live = np.zeros(words, np.uint64), None
    out = np.zeros(words, np.uint64)
    for p in range(0, bits, 2):
        x, y = plane(p, live), plane(p + 1, live)
        c = counters[0]
        half = c ^ x
        carry = (c & x) | (half & y)
        counters[0] = half ^ y
        for i in range(1, k):
            c = counters[i]
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if p % _LOOK == _LOOK - 2 and p + 2 < bits:
            alive = np.flatnonzero(over != _ONES)
            if len(alive) < 0.8 * len(over):
                live = alive if live is None else live[alive]
                counters, over = [c[alive] for c in counters], over[alive]
                if not len(alive):
                    return out
    out[slice(None) if live is None else live] = ~over
    return out


def planes(prints: np.ndarray) -> np.ndarray:
    """Fingerprints (n rows of bytes) as bit planes: (bits, words of 64 rows), the last word filled with zeros."""
    n, width = prints.shape
    padded = np.zeros((-(-n // 64) * 64, width), np.uint8)
    padded[:n] = prints
    vertical = np.packbits(np.unpackbits(padded, axis=1).T, axis=1, bitorder="little")
    return np.ascontiguousarray(vertical).view("<u8")


def set_bits(words: np.ndarray, n: int) -> np.ndarray:
    """Positions of the set bits among the first n."""
    found = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    return found[found < n]


def close_in_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Rows i at which fingerprints a[i] and b[i] differ in at most ``radius`` bits."""
    at, n, width = 0, len(a), a.shape[1]
    found = []
    while at < n:
        d = a[at : at + (1 << 16)] ^ b[at : at + (1 << 16)]
        v = planes(d)
        words = within(lambda p, live, v=v: v[p] if live is None else v[p][live], v.shape[1], 8 * width, radius)
        found.append(set_bits(words, len(d)) + at)
        at += len(d)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def close_across(a: np.ndarray, b: np.ndarray, radius: int, queries: int = 128):
    """Yields (i, j), arrays of rows of a and b that differ in at most ``radius`` bits, a run of ``queries`` rows of a at a time."""
    v = planes(b)
    words = v.shape[1]
    bits = np.unpackbits(a, axis=1).astype(np.uint64) * _ONES
    for at in range(0, len(a), queries):
        mask = bits[at : at + queries]
        m = len(mask)

        def plane(p: int, live: np.ndarray | None, mask: np.ndarray = mask) -> np.ndarray:
            if live is None:
                return (mask[:, p][:, None] ^ v[p][None, :]).ravel()
            return mask[live // words, p] ^ v[p][live % words]

        got = within(plane, m * words, 8 * a.shape[1], radius)
        found = set_bits(got, m * words * 64)
        i, j = found // (words * 64), found % (words * 64)
        real = j < len(b)
        yield i[real] + at, j[real]


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j in ``labels``, which holds a smaller member, or itself, for each row."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
