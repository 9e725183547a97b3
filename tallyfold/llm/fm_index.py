"""A compressed FM-index over many short sequences, searched for all of them at once.

The sequences' symbols stand in one text with separators. Suffixes are sorted by at least ``depth`` symbols; the symbols before
them (the transform) are kept in a wavelet matrix: one packed bit per symbol and level, with a running count for every 64. A
backward step is one rank query. Rows whose first ``depth`` symbols agree form a group; a match is never longer than ``depth``, so
that after each step the interval is that of the group.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit array with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols 0 to 2 ** levels - 1, with the number of a symbol before a position."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            ones = bit.astype(bool)
            self.zeros.append(int(len(bit) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.start = self._walk(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].rank(at)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._walk(symbol, at) - self.start[symbol]


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols or more, by doubling, and the first row of each row's group.

    Two rows are in one group if their first ``depth`` symbols agree.
    """
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, by_length = rank.astype(np.int64), {1: rank.astype(np.int64)}
    length = 1
    while length < depth:
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        length *= 2
        by_length[length] = rank
    order = np.argsort(rank, kind="stable")
    # The first ``depth`` symbols agree when those of two overlapping powers of two do.
    half = length if length == depth else length // 2
    first = by_length[half]
    second = np.full(n, -1, np.int64)
    second[: max(0, n - (depth - half))] = first[depth - half :]
    new = np.ones(n, bool)
    new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    return order, np.maximum.accumulate(np.where(new, np.arange(n), 0))


class FmIndex:
    """Index of sequences of symbols (1 and up) that lie in a row in ``symbols`` and end at ``ends``."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, depth: int):
        self.depth = depth
        sizes = np.diff(ends, prepend=0)
        self.place = np.arange(len(symbols)) + np.repeat(np.arange(len(ends)), sizes)
        text = np.zeros(len(symbols) + len(ends), np.int64)
        text[self.place] = symbols
        rows, self.group = sorted_suffixes(text, depth)
        self.transform = WaveletMatrix(text[rows - 1])
        counts = np.bincount(text)
        self.smaller = np.cumsum(counts) - counts
        # The earliest place in the text of the rows of each group.
        starts = np.flatnonzero(self.group == np.arange(len(text)))
        self.earliest = np.zeros(len(text), np.int64)
        self.earliest[starts] = np.minimum.reduceat(rows, starts)

    def seen_before(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Stream the indexed sequences through the index; for each symbol, whether the match of ``depth`` symbols that starts
        there (within its sequence) also starts earlier in the text.

        All sequences take a backward step together. The length of the match so far is the matching statistic, held at ``depth``.
        """
        sizes = np.diff(ends, prepend=0)
        by_size = np.argsort(-sizes, kind="stable")
        last, sizes = (ends - 1)[by_size], sizes[by_size]
        row = np.zeros(len(sizes), np.int64)
        out = np.zeros(len(symbols), bool)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -step))
            if active == 0:
                break
            at = last[:active] - step
            symbol = symbols[at]
            row = self.smaller[symbol] + self.transform.rank(symbol, row[:active])
            if step + 1 >= self.depth:
                row = self.group[row]
                out[at] = self.earliest[row] < self.place[at]
        return out
