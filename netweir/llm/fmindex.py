"""A compressed full-text index over word numbers, and truncated matching statistics by backward search."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with running counts: an eighth of a byte a bit and half again for the counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.ones = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletTree:
    """Ranks of any symbol in a sequence; a level for each bit, zeros of a level stably before its ones."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        s = symbols
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (s >> bit) & 1 == 1
            vector = BitVector(ones)
            self.levels.append((bit, vector, len(s) - vector.ones))
            s = np.concatenate((s[~ones], s[ones]))
        self.first = self.follow(np.arange(sigma), np.zeros(sigma, np.int64))

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.rank(i)
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self.follow(symbol, i) - self.first[symbol]


class FMIndex:
    """Index of sequences of word numbers (1 and up) for patterns of up to ``depth`` words.

    Suffixes are ordered by their first ``depth`` words, by doubling; further words would not change what an
    interval of so short a pattern holds.  0 stands after each sequence.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.n = depth, len(text)
        sigma = int(text.max()) + 1 if len(text) else 1
        ranks, size = text.astype(np.int64), 1
        while size * 2 <= depth - 1:
            ranks, size = self._joined(ranks, size), size * 2
        shorter = self._joined(ranks, depth - 1 - size) if depth - 1 > size else ranks
        full = self._joined(ranks, depth - size)
        order = np.argsort(full, kind="stable")
        self.tree = WaveletTree(text[order - 1], sigma)
        counts = np.bincount(text, minlength=sigma)
        self.begin = np.cumsum(counts) - counts
        # where the interval of all suffixes that agree in all but the last word starts and ends
        change = np.flatnonzero(np.diff(shorter[order])) + 1
        edges = np.concatenate(([0], change, [self.n]))
        which = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.wide_low, self.wide_high = edges[:-1][which].astype(np.int32), edges[1:][which].astype(np.int32)

    def _joined(self, ranks: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by a run of words and the run that begins ``shift`` later; 0 beyond the end."""
        later = np.zeros_like(ranks)
        later[: max(0, len(ranks) - shift)] = ranks[shift:]
        return np.unique(ranks * (int(ranks.max()) + 1) + later, return_inverse=True)[1] if len(ranks) else ranks

    def repeated(self, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
        """For sequences that the index holds: whether each window of ``depth`` words is in it twice or more.

        All sequences are searched backwards at once.  After ``depth`` words the last one is let go before the next
        is added, so an interval always is that of a whole window.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        out = [np.zeros(max(0, n - self.depth + 1), bool) for n in lengths.tolist()]
        flat = np.zeros(int(np.maximum(lengths - self.depth + 1, 0).sum()), bool)
        base = np.cumsum(np.maximum(lengths - self.depth + 1, 0)) - np.maximum(lengths - self.depth + 1, 0)
        for step in range(int(lengths.max()) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))
            at = lengths[:live] - 1 - step
            lo, hi = low[:live], high[:live]
            if step >= self.depth:
                lo, hi = self.wide_low[lo].astype(np.int64), self.wide_high[lo].astype(np.int64)
            symbol = text[starts[:live] + at]
            low[:live] = self.begin[symbol] + self.tree.rank(symbol, lo)
            high[:live] = self.begin[symbol] + self.tree.rank(symbol, hi)
            if step >= self.depth - 1:
                flat[base[:live] + at] = high[:live] - low[:live] > 1
        for i, o in enumerate(order.tolist()):
            out[o] = flat[base[i] : base[i] + max(0, int(lengths[i]) - self.depth + 1)]
        return out
