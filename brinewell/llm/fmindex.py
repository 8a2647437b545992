"""A word-level FM-index on a wavelet matrix of packed bits, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class Wavelet:
    """Counts of a symbol before a position, in one rank a bit of the symbol."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(depth - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of the symbol's run at the bottom, and its counts before lo and before hi added to it."""
        start = np.zeros_like(lo)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            at = np.concatenate([start, lo, hi])
            ones = bits.rank(at)
            at = np.where(np.tile(one, 3), zeros + ones, at - ones)
            start, lo, hi = np.split(at, 3)
        return start, lo, hi


class FMIndex:
    """Matching statistics, up to the threshold `width`, of stretches of a sequence of symbols against the whole of it."""

    def __init__(self, text: np.ndarray, width: int):
        n = len(text)
        bits = max(1, int(text.max() if n else 0).bit_length())
        k = max(1, min(3, width // 2, 63 // bits))  # symbols that one sort key holds
        rank = np.zeros(n, np.int64)
        for i in range(k):
            rank = rank << bits | self._ahead(text, i, 0)
        order, rank = self._ranked(rank)
        while k < width:  # suffixes sorted by `width` symbols at least: enough for patterns of that length
            half, step = rank, k
            order, rank = self._ranked(rank * (n + 2) + self._ahead(rank, k, -1) + 1)
            k *= 2
        # groups of suffixes that share width - 1 symbols: two overlapping stretches of `step` cover them
        gap = width - 1 - step
        both = half * (n + 2) + self._ahead(half, gap, -1) + 1 if gap >= 0 else half
        s = both[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        self.wide_lo, self.wide_hi = edge[:-1][group], edge[1:][group]
        self.suffix, self.n = order, n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.wavelet = Wavelet(text[order - 1], bits)

    @staticmethod
    def _ahead(values: np.ndarray, k: int, beyond: int) -> np.ndarray:
        return np.concatenate([values[k:], np.full(min(k, len(values)), beyond, np.int64)]) if k else values

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        return order, rank

    def _left(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run, a, b = self.wavelet.rank(symbol, lo, hi)
        return self.first[symbol] + a - run, self.first[symbol] + b - run

    def windows(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """For the `size` windows of `width` symbols from each start, one stretch after another: the first suffix of each window's range.

        A stretch's last window is searched backward from its end; each window
        before it drops the last symbol, by widening the range to the suffixes
        that share width - 1 symbols, and takes one more on the left.
        """
        out = np.empty(int(size.sum()), np.int64)
        at = np.cumsum(size) - 1
        by_size = np.argsort(-size, kind="stable")
        start, size, at = start[by_size], size[by_size], at[by_size]
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        for t in range(width - 1, -1, -1):
            lo, hi = self._left(text[start + size - 1 + t], lo, hi)
        out[at] = lo
        for back in range(1, int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -back, "left"))  # stretches of more than `back` windows
            lo, hi = self.wide_lo[lo[:live]], self.wide_hi[lo[:live]]
            lo, hi = self._left(text[start[:live] + size[:live] - 1 - back], lo, hi)
            out[at[:live] - back] = lo
        return out
