"""Words of texts as 64-bit hashes, for whole batches at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes depend on the
bytes alone, so they agree between processes and machines.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20_240_229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[9, 10, 11, 12, 13, 32]] = True
#: Where words end if punctuation doesn't belong to them: all ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BASE = 0x9E3779B97F4A7C15 | 1
TERMS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        p = np.empty(size, np.uint64)
        p[0] = 1
        have = 1
        while have < size:
            n = min(have, size - have)
            p[have : have + n] = p[:n] * U(pow(base, have, 2**64))
            have += n
        out.append(p)
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse; a long text makes a larger table, which isn't kept for long."""
    return _powers(1 << max(20, int(size).bit_length()))


class Words(NamedTuple):
    hashes: np.ndarray  #: of each word
    starts: np.ndarray  #: first byte
    ends: np.ndarray  #: byte after the last
    rows: np.ndarray  #: where each row's words begin, and their number


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = BREAK) -> Words:
    """The words of rows of text; ``offsets`` begin at 0. ``lower``: A-Z count as a-z; ``breaks``: bytes that aren't in words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    if lower:
        data = LOWER[data]
    word = ~breaks[data]
    first = np.empty(len(data) + 1, bool)
    first[0], first[-1] = True, True
    first[1:-1] = ~word[:-1]
    first[offsets] = True  # a row's first byte begins a word whatever the row before ended with
    starts = np.flatnonzero(word & first[:-1])
    last = np.empty(len(data), bool)
    last[:-1], last[-1] = ~word[1:], True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(word & last) + 1
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def row_of(rows: np.ndarray) -> np.ndarray:
    """Of each word (or of each other part), the row."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` consecutive words, whatever rows they lie in."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64)
    if n <= 16:
        out = hashes[: total - n + 1] * TERMS[0]
        for k in range(1, n):
            out += hashes[k : total - n + 1 + k] * TERMS[k]
    else:
        up, down = powers(total + 1)
        sums = np.empty(total + 1, np.uint64)
        sums[0] = 0
        np.cumsum(hashes * up[:total], out=sums[1:])
        out = (sums[n:] - sums[:-n]) * down[: total - n + 1]
    return mix(out)


def inside(rows: np.ndarray, n: int) -> np.ndarray:
    """The positions from which ``n`` words of the same row follow."""
    end = np.repeat(rows[1:], np.diff(rows))
    return np.flatnonzero(np.arange(len(end)) + n <= end)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n`` consecutive words of one row, and the position of the first."""
    at = inside(rows, n)
    return runs(hashes, n)[at], at


def minimizers(keys: np.ndarray, w: int) -> np.ndarray:
    """Of each ``w`` consecutive keys, the position of the smallest (the first of equal ones): equal runs of keys choose alike."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(keys))
    have = 1
    while have < w:  # windows of twice the width, then the rest
        step = min(have, w - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(keys[b] < keys[a], b, a)
        have += step
    return best[:n]
