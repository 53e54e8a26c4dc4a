"""Words and their hashes for whole Arrow batches at once, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The six white-space bytes, and an odd base with its inverse modulo 2**64.
WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 18


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to 2 * BLOCK."""
    size = 2 * BLOCK
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))]) for base in (BASE, INVERSE))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every run of bytes that aren't `between` words; as set, of every [^\\x20\\x09-\\x0D]+."""
    inside = ~between[data]
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    begin = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: sum of (byte + 1) * BASE ** place, mixed. Spans are in order and disjoint.

    Goes by blocks of bytes, so what it holds beside the result is bounded however long a text or a span is.
    """
    power, inverse = _powers()
    out = np.empty(len(begin), np.uint64)
    cuts = np.unique(np.searchsorted(begin, np.arange(0, len(data) + BLOCK, BLOCK)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        lo = begin[i]
        hi = min(end[j - 1], lo + 2 * BLOCK)
        part = data[lo:hi]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)])])
        first = begin[i:j] - lo
        out[i:j] = (sums[np.minimum(end[i:j], hi) - lo] - sums[first]) * inverse[first]
        for at in range(hi, end[j - 1], BLOCK):
            part = data[at : min(at + BLOCK, end[j - 1])]
            rest = int(((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)]).sum())
            out[j - 1 : j] += np.array([rest * pow(BASE, int(at - begin[j - 1]), 1 << 64) % (1 << 64)], np.uint64)
    return mixed(out + (end - begin).astype(np.uint64))
