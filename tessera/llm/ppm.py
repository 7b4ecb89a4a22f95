"""Prediction by partial matching over bytes: escape estimation and symbol exclusion, on sorted arrays of contexts.

A byte's probability depends on its context of up to ORDER bytes only. A code is a context with the byte after it: the latest
byte of the context highest, the byte itself lowest. Sorted codes that share their latest two context bytes hold all that
shorter contexts down to two bytes need, so they can be a shard; contexts of one byte and of none are one small table.
"""

from __future__ import annotations

import numpy as np

ORDER = 5
#: Bytes that UTF-8 never has: the end of a text, and what stands before it.
END, PAD = 0xFF, 0xFE
#: Symbols that a text can have: bytes but PAD.
ALPHABET = 255
#: Codes of a slice whose levels are held at a time; a context of two bytes is never cut.
SLICE = 1 << 19
LOW = np.uint64(0xFF)


def codes_of(texts: list[bytes], order: int) -> np.ndarray:
    """The code of each byte and end of the texts, in order; context bytes before a text's start are PAD."""
    tail = bytes([END]) + bytes([PAD]) * max(order, 1)
    flat = np.frombuffer(bytes([PAD]) * 8 + tail.join([*texts, b""]), np.uint8)
    n = len(flat) - 8
    if not n:
        return np.zeros(0, np.uint64)
    long = np.concatenate([flat, np.full(16, PAD, np.uint8)])
    codes = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = np.frombuffer(long[r : r + (n + 7) // 8 * 8].tobytes(), "<u8")
        codes[r::8][: len(part)] = part
    del long
    real = flat[8:] != PAD
    codes = codes[:n][real]
    codes &= kept(max(order, 1))
    codes |= flat[8:][real]
    return codes


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the place of each code among them: np.unique() in half its memory. The codes given are sorted in
    place, so they must be the caller's own."""
    at = np.argsort(codes)
    if len(codes) < 1 << 31:
        at = at.astype(np.int32)
    codes.sort()
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    place = np.empty_like(at)
    place[at] = np.cumsum(new, dtype=at.dtype) - 1
    return codes[new], place


def kept(length: int) -> np.uint64:
    """A mask of the latest bytes of a context."""
    return np.uint64((0xFFFFFFFFFFFFFFFF << (64 - 8 * length)) & 0xFFFFFFFFFFFFFFFF)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sums of their counts."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    at = np.argsort(codes)
    codes, counts = codes[at], counts[at]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def pairs_of(codes: np.ndarray) -> np.ndarray:
    """The place of each code's last context byte and symbol in a table of pairs."""
    return ((codes >> np.uint64(56) << np.uint64(8)) | (codes & LOW)).astype(np.int64)


def log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


class Level:
    """What one length of context says of each (context, symbol): fresh, and after the escape from the longer context.

    fresh is log10 of the probability where no longer context is known; passed is what is added on escaping to shorter ones.
    """

    def __init__(self, count: np.ndarray, group: np.ndarray, there: np.ndarray, least: int, below: Level | None, up: np.ndarray | None):
        n = int(group[-1]) + 1 if len(group) else 0
        total = lambda x: np.bincount(group, weights=x, minlength=n)[group]
        self.count = np.where(there, count, 0).astype(np.float64)
        self.keeps = self.count >= least
        self.seen = total(self.keeps)
        self.total = total(self.count)
        self.rest = self.total - total(np.where(self.keeps, self.count, 0))  # what was too rare to keep counts towards the escape
        known = self.seen > 0
        if below is None:
            self.passed = -np.log10(np.maximum(1, ALPHABET - self.seen))
            shorter = self.passed
        else:
            size = below.total[up] - total(np.where(self.keeps, below.count[up], 0))
            away = (below.seen[up] - self.seen) / 2 + below.rest[up]
            escape = np.where(size > 0, log(away) - log(size), 0.0) + below.passed[up]
            self.passed = np.where(below.keeps[up], log(below.count[up] - 0.5) - log(size), escape)
            shorter = below.fresh[up]
        mine = np.where(self.keeps, log(self.count - 0.5) - log(self.total), log(self.seen / 2 + self.rest) - log(self.total) + self.passed)
        self.fresh = np.where(known, mine, shorter)


def base(pairs: np.ndarray, order: int, least: int) -> Level:
    """The level of contexts of one byte, or of none for order 0, over all pairs of bytes, from the counts of pairs."""
    symbol = np.tile(np.arange(256), 256)
    every = np.ones(256, bool)
    root = Level(pairs.reshape(256, 256).sum(axis=0), np.zeros(256, np.int64), every, least, None, None)
    context = np.repeat(np.arange(256), 256)
    return Level(pairs, context, (context != PAD) & (order > 0), least, root, symbol)


def costs(codes: np.ndarray, counts: np.ndarray, order: int, least: int, low: Level) -> np.ndarray:
    """log10 probability of each of sorted distinct codes, which hold all codes of their contexts of two bytes."""
    out = np.empty(len(codes), np.float32)
    if order < 2:
        return low.fresh[pairs_of(codes)].astype(np.float32)
    start = 0
    while start < len(codes):
        end = start + SLICE
        if end < len(codes):
            end = int(np.searchsorted(codes, (codes[end - 1] & kept(2)) | ~kept(2), side="right"))
        c, n = codes[start:end], counts[start:end]
        keys, sizes, ups = [c], [n], []
        for k in range(order - 1, 1, -1):
            shorter, up = np.unique((keys[-1] & kept(k)) | (keys[-1] & LOW), return_inverse=True)
            ups.append(up)
            keys.append(shorter)
            sizes.append(np.bincount(up, weights=sizes[-1], minlength=len(shorter)))
        ups.append(pairs_of(keys[-1]))
        level = low
        for k, (key, size, up) in enumerate(zip(reversed(keys), reversed(sizes), reversed(ups)), 2):
            context = key & kept(k)
            group = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]]).astype(np.int64))
            level = Level(size, group, (key >> np.uint64(64 - 8 * k)) & LOW != PAD, least, level, up)
        out[start:end] = level.fresh
        start = end
    return out
