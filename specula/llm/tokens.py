"""Words, hashes and shingles of a chunk of texts in numpy, straight from Arrow's bytes.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial over random 64-bit values of its bytes, so
all hashes of a chunk come from one running sum; folding A-Z to a-z costs nothing, as it is a matter of the byte values.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed random 64-bit values."""
    with np.errstate(over="ignore"):
        return fmix(U(seed) + np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(33))
        x = x * U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(33)
        return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, seed: int):
        self.base = int(splitmix(seed, 1)[0]) | 1
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.cumprod(steps))
        return self.up, self.down


class Lane:
    """One of several independent hash functions of words and of word ranges."""

    def __init__(self, seed: int, fold: bool):
        self.byte = splitmix(seed, 256)
        if fold:
            self.byte[65:91] = self.byte[97:123]
        self.inner, self.outer = Powers(seed + 1), Powers(seed + 2)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        up, down = self.inner.to(len(data) + 1)
        return fmix(_between(self.byte[data] * up[: len(data)], starts, ends) * down[starts])

    def running(self, hashes: np.ndarray) -> np.ndarray:
        """What ``ranges`` needs of the words' hashes."""
        up, _ = self.outer.to(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=out[1:])
        return out

    def ranges(self, running: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [first, end); ends and starts are places in the chunk."""
        _, down = self.outer.to(len(running))
        return fmix((running[end] - running[first]) * down[first] + (end - first).astype(np.uint64))


def _between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte and end of every word, number of the first word of each text and behind the last)."""
    inside = ~((data == 32) | ((data - np.uint8(9)) <= 4))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])[:-1] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside, [False]])[1:] if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, firsts: np.ndarray, width: int, lane: Lane) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; number of the first one of each text and behind the last).

    A text of fewer words than ``width`` has its whole sequence as the one shingle, a text without words none.
    """
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(hashes)) + width <= firsts[1:][rows]) if len(hashes) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    first = np.concatenate([at, firsts[short]])
    end = np.concatenate([at + width, firsts[short + 1]])
    row = np.concatenate([rows[at], short]).astype(np.int64)
    values = lane.ranges(lane.running(hashes), first, end)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(counts) + 1))
