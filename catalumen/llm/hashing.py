"""Words, windows and their 64-bit hashes for a whole run of texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def randoms(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers, the same in every task."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a one-to-one map)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> np.ndarray:
    """BASE to the power 0 .. n - 1, modulo 2^64."""
    out = np.full(max(n, 1), BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTE_VALUES = randoms(256, 1)


class WordRun:
    """Words (runs of bytes other than blank and 0x09 to 0x0D) of texts that stand one after the other.

    ``start`` and ``end`` are byte positions, ``upto`` counts the words before
    each text, ``of`` names each word's text and ``hash`` is its 64-bit hash.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        first[edges] = ~blank[edges]
        last[edges - 1] = ~blank[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.upto = np.searchsorted(self.start, at)
        self.of = np.repeat(np.arange(len(at) - 1), np.diff(self.upto))
        self.hash = np.zeros(0, U)
        if len(self.start):
            length = self.end - self.start
            inside = np.flatnonzero(~blank)
            begin = np.concatenate([[0], np.cumsum(length)])[:-1]
            place = np.arange(len(inside)) - np.repeat(begin, length)
            values = BYTE_VALUES
            if lower:
                values = values.copy()
                values[65:91] = BYTE_VALUES[97:123]
            terms = values[data[inside]] * powers(int(length.max()))[place]
            self.hash = mix(np.add.reduceat(terms, begin) + length.astype(U))

    def windows(self, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window of ``size`` words within one text, and the word it starts with."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        total = np.zeros(n, U)
        for i, c in enumerate(randoms(size, seed)):
            total += self.hash[i:i + n] * c
        whole = np.flatnonzero(self.of[:n] == self.of[size - 1:])
        return mix(total[whole]), whole
