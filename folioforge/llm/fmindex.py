"""An FM-index over integer symbols in numpy: suffix order, wavelet matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int | None = None, ranks: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Suffix array by prefix doubling. With depth, suffixes need be in order only as far as that many symbols.

    ranks gets, for each of its keys that is a power of two, the rank of every suffix's first so many symbols.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        if ranks is not None and width in ranks:
            ranks[width] = rank
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n or (depth and width >= depth):
            return order


class Bits:
    """A bit vector in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Symbols are 1..sigma; a symbol 0 is put at the end. sample: every so many text positions are kept (0: none)."""

    def __init__(self, symbols: np.ndarray, depth: int | None = None, sample: int = 0, ranks: dict[int, np.ndarray] | None = None):
        text = np.concatenate([symbols.astype(np.int64), [0]])
        self.n = n = len(text)
        self.order = order = suffix_order(text, depth, ranks)
        bwt = text[order - 1]
        self.sigma = int(text.max())
        self.levels, x = [], bwt
        for level in reversed(range(max(1, self.sigma.bit_length()))):
            one = (x >> level) & 1 == 1
            self.levels.append((level, Bits(one), int(n - one.sum())))
            x = np.concatenate([x[~one], x[one]])
        counts = np.bincount(text, minlength=self.sigma + 1)
        first = np.cumsum(counts) - counts
        every = np.arange(self.sigma + 1)
        self.base = np.zeros(self.sigma + 1, np.int64)
        self.base = first - self._fall(every, np.zeros(self.sigma + 1, np.int64))
        if sample:
            kept = order % sample == 0
            self.kept, self.samples = Bits(kept), order[kept]
            del self.order

    def _fall(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            r = bits.ones(i)
            i = np.where((c >> level) & 1 == 1, zeros + r, i - r)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The row bound after the symbol c is put before what the bound i stands for."""
        return self.base[c] + self._fall(c, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of patterns of one length (a matrix, one row each; symbols below 1 or above sigma match nothing)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.flatnonzero(((patterns > 0) & (patterns <= self.sigma)).all(axis=1))
        hi[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            one = bits.get(i)
            r = bits.ones(i)
            i = np.where(one, zeros + r, i - r)
            c |= one.astype(np.int64) << level
        return c

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to the nearest kept position."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = self.kept.get(at[live])
            done = live[here]
            out[done] = self.samples[self.kept.ones(at[done])] + steps[done]
            live = live[~here]
            at[live] = self.step(self.symbol(at[live]), at[live])
            steps[live] += 1
        return out
