"""An FM-index over integer sequences: BWT in a wavelet tree, batched search.

Suffixes are sorted to a depth that covers the longest pattern asked for, which
is all that backward search of such patterns needs.
"""

from __future__ import annotations

import numpy as np


# Ones among the first k bits of a byte, at 8 * byte + k.
PREFIX = np.array([bin(b & ((1 << k) - 1)).count("1") for b in range(256) for k in range(8)], np.int64)


class Bits:
    """A packed bit vector with rank: each byte beside the ones before it."""

    def __init__(self, bits: np.ndarray):
        packed = np.append(np.packbits(bits, bitorder="little"), np.uint8(0)).astype(np.int64)
        ones = np.array([bin(i).count("1") for i in range(256)], np.int64)[packed]
        self.cells = (np.cumsum(ones) - ones) << 8 | packed

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        cell = self.cells[i >> 3]
        return (cell >> 8) + PREFIX[(cell & 255) << 3 | i & 7]


class WaveletTree:
    """Rank of any symbol by one bit vector a level (most significant first),
    symbols with a zero bit before those with a one."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``i`` values, elementwise; ``i``
        may have several rows."""
        at = np.concatenate([np.zeros((1, len(symbol)), np.int64), np.atleast_2d(i)])
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros):
            ones = bits.rank1(at)
            at = np.where(((symbol >> level) & 1).astype(bool), zeros + ones, at - ones)
        return (at[1:] - at[0]).reshape(np.shape(i))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling)."""
    rank, k = text.astype(np.int64), 1
    while True:
        second = np.concatenate([rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64)])
        key = rank * (int(second.max(initial=0)) + 1) + second
        order = np.argsort(key, kind="stable")
        k *= 2
        if k >= depth:
            return order
        sorted_ = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])


class FMIndex:
    """``text``: dense symbols from 0, which nothing matches; ``depth``: the longest
    pattern; ``weight`` of each position: how often its sequence is held."""

    def __init__(self, text: np.ndarray, depth: int, weight: np.ndarray | None = None):
        text = np.append(text + 1, 0)  # an end that no pattern has
        order = suffix_order(text, depth)
        self.tree = WaveletTree(text[order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.n = len(text)
        held = np.ones(self.n, np.int64) if weight is None else np.append(weight, 0)[order]
        self.held = np.concatenate([[0], np.cumsum(held)])

    def matching(self, stream: np.ndarray, ends: np.ndarray, most: np.ndarray | int, least_count: int = 2) -> np.ndarray:
        """Matching statistics: for each end position in ``stream``, the length (up
        to ``most``) of the longest run of symbols ending there (inclusive) that
        the index holds ``least_count`` times. Searches advance together."""
        length = np.zeros(len(ends), np.int64)
        most = np.minimum(ends + 1, most)
        live = np.flatnonzero(most > 0)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        step = 0
        while len(live):
            symbol = stream[ends[live] - step]
            lo, hi = self._step(symbol, lo, hi)
            step += 1
            ok = (symbol > 0) & (self.held[hi] - self.held[lo] >= least_count)
            length[live[ok]] = step
            ok &= most[live] > step
            live, lo, hi = live[ok], lo[ok], hi[ok]
        return length

    def _step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The intervals of patterns with one symbol more in front."""
        c = symbol + 1
        return self.before[c] + self.tree.rank(c, np.stack([lo, hi]))

    def repeats(self, stream: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, offset, n): runs of n windows of the patterns
        ``stream[first : first + size]`` that the index holds twice.

        A search from a pattern's end reports all windows within its match. Where it
        breaks, at p, runs from p on are tried, of 1, 2, 4... symbols, until one is
        held once; the search goes on before that run's end, since all windows over
        it fail. A step takes every pattern's search or trial one symbol on."""
        out = []
        own = np.flatnonzero(size >= window)  # of the pattern, as all arrays here
        start, end = first[own], (first + size - 1)[own]
        last, depth, tried = end.copy(), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)  # tried: symbols of a trial, 0 in a search
        broke = np.zeros(len(own), np.int64)
        lo, hi = np.zeros(len(own), np.int64), np.full(len(own), self.n, np.int64)
        while len(own):
            at = last - depth
            symbol = stream[at]
            lo, hi = self._step(symbol, lo, hi)
            held = (symbol > 0) & (self.held[hi] - self.held[lo] >= 2)
            depth += held
            search = tried == 0
            over = np.where(search, ~held | (at == start), ~held | (at == broke))
            if not over.any():
                continue
            done = over & search
            hit = done & (depth >= window)
            out.append((own[hit], (last - depth + 1 - start)[hit], (depth - window + 1)[hit]))
            ended = done & held  # the whole pattern
            trial = done & ~held
            broke[trial], end[trial], tried[trial] = at[trial], last[trial], 1
            again = over & ~search & held
            tried[again] *= 2
            trial |= again
            last[trial] = (broke + tried - 1)[trial]
            # A trial as long as what the search had is known to be held once.
            once = over & ~search & ~held
            bound = np.where(once, last, end)
            once |= trial & (last >= end)
            last[once] = np.minimum(broke + window, bound)[once] - 1
            tried[once] = 0
            ended |= once & (last - start + 1 < window)
            depth[over], lo[over], hi[over] = 0, 0, self.n
            if ended.any():
                own, start, end, last, depth, tried, broke, lo, hi = (x[~ended] for x in (own, start, end, last, depth, tried, broke, lo, hi))
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
