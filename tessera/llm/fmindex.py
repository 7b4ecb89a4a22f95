"""A compressed FM-index over sequences of integers: BWT in a wavelet matrix of bit vectors, ranks and suffixes sampled.

What stays after the build is bits: of the BWT, a bit for each bit of a symbol, and a mark for each sampled suffix. The suffix array is
dropped but for its samples, from which the places of an interval are found again by steps along the text.
"""

from __future__ import annotations

import numpy as np

#: Places of the text between samples of the suffix array.
SAMPLE = 8


class Bits:
    """A bit vector in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, bits.dtype)]).astype(np.uint8), bitorder="little").view(np.uint64)
        self.words = packed
        self.before = np.zeros(len(packed), np.int32)
        np.cumsum(np.bitwise_count(packed[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


class Wavelet:
    """Ranks of symbols: one bit vector for each bit of a symbol, high bits first, zeros before ones at each level."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels = []
        for k in range(width - 1, -1, -1):
            bit = (symbols >> k) & 1
            self.levels.append((k, Bits(bit), len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        #: Where a symbol's run starts once all levels are done.
        self.first = np.zeros((1 << width) + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=1 << width), out=self.first[1:])
        order = np.arange(1 << width)
        rev = np.zeros(1 << width, np.int64)
        for k in range(width):
            rev |= ((order >> k) & 1) << (width - 1 - k)
        counts = np.bincount(symbols, minlength=1 << width)[np.argsort(rev, kind="stable")]
        start = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.start = np.empty(1 << width, np.int64)
        self.start[np.argsort(rev, kind="stable")] = start

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        for k, bits, zeros in self.levels:
            one = ((symbol >> k) & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at - self.start[symbol]


    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for k, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << k
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Over sequences laid end to end: text holds symbols 1 and up, ends the exclusive end of each sequence.

    Each sequence gets a terminator of its own, so that suffixes are in full order after few doublings of a prefix.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        sizes = np.diff(np.concatenate([[0], ends]))
        n, m = len(text) + len(ends), len(ends)
        stop = ends + np.arange(m)
        full = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[stop] = False
        full[inside] = text
        rank = full + m
        rank[stop] = np.arange(m)
        longest, bits = int(sizes.max(initial=0)) + 1, max(1, int(rank.max(initial=0)).bit_length())
        depth = max(1, 62 // bits)  # as many symbols as a number holds make the first prefix
        padded = np.concatenate([rank, np.zeros(depth, np.int64)])
        rank = padded[:n].copy()
        for k in range(1, depth):
            rank = (rank << bits) | padded[k : n + k]
        order = np.argsort(rank)
        while True:
            ordered = rank[order]
            dense = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = dense
            if depth >= longest or dense[-1] == n - 1:
                break
            later = np.zeros(n, np.int64)
            later[:-depth] = rank[depth:] + 1
            rank = rank * (n + 1) + later
            order = np.argsort(rank)
            depth *= 2
        width = max(1, int(full.max(initial=0)).bit_length())
        self.bwt = Wavelet(full[order - 1], width)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(full, minlength=1 << width))])
        self.n = n
        # Sampled: every SAMPLE-th place of the text, and each sequence's first, as a step back from there would leave it.
        begins = np.concatenate([[0], stop[:-1] + 1]) if m else np.zeros(0, np.int64)
        some = np.zeros(n, bool)
        some[::SAMPLE] = some[begins] = True
        marked = some[order]
        self.marked = Bits(marked)
        self.samples = np.searchsorted(stop, order[marked]).astype(np.int32)

    def sequences(self, at: np.ndarray) -> np.ndarray:
        """The sequence that each suffix, given by its rank, begins in: back along the text to the next sample."""
        out, left, at = np.empty(len(at), np.int64), np.arange(len(at)), at.astype(np.int64)
        while len(left):
            hit = self.marked.get(at)
            out[left[hit]] = self.samples[self.marked.rank(at[hit])]
            left, at = left[~hit], at[~hit]
            symbol, before = self.bwt.access(at)
            at = self.less[symbol] + before
        return out

    def search(self, patterns, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many patterns of one length at once; patterns(k) gives their k-th symbols. Suffix intervals [lo, hi)."""
        last = patterns(length - 1)
        lo, hi = self.less[last], self.less[last + 1]
        for k in range(length - 2, -1, -1):
            c = patterns(k)
            lo, hi = self.less[c] + self.bwt.rank(c, lo), self.less[c] + self.bwt.rank(c, hi)
        return lo, hi

    def statistics(self, symbols, most: int, n: int, own: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of n places of streamed texts: (length, lo, hi).

        symbols(k, some) gives the symbols k places before some of the places. Each place's match is extended backward, symbol by
        symbol, while it stands in more than own places of the index (1 where the text itself is one of them), and to most symbols at
        most: length is that of the longest such match that ends at the place. lo and hi are its suffix interval where it has most.
        """
        length, out = np.zeros(n, np.int64), (np.zeros(n, np.int64), np.zeros(n, np.int64))
        some, lo, hi = np.arange(n), None, None
        for k in range(most):
            c = symbols(k, some)
            lo, hi = (self.less[c], self.less[c + 1]) if lo is None else (self.less[c] + self.bwt.rank(c, lo), self.less[c] + self.bwt.rank(c, hi))
            on = hi - lo > own
            some, lo, hi = some[on], lo[on], hi[on]
            length[some] = k + 1
        out[0][some], out[1][some] = lo, hi
        return length, *out


def interval_minima(value, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of value(ranks) over each non-empty interval; each interval's ranks are looked up once."""
    if not len(lo):
        return np.zeros(0, np.int64)
    each, back = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
    size = each[:, 1] - each[:, 0]
    begin = np.cumsum(size) - size
    ranks = np.arange(size.sum()) + np.repeat(each[:, 0] - begin, size)
    return np.minimum.reduceat(value(ranks), begin)[back.reshape(-1)]
