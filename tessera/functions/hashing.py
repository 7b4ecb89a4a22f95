"""Byte hashes of strings as column expressions: FNV-1a of 32 and 64 bits, and a 64-bit finaliser."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

# Fixed values of the published FNV-1a hash.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 14695981039346656037, 1099511628211
#: Keys that are hashed one by one once no more are as long.
FEW = 16


def fnv1a(keys: pa.Array, offset: int, prime: int, kind: type) -> np.ndarray:
    """FNV-1a of the UTF-8 bytes of strings: a byte of all keys that are as long at a time; the last few, very long keys alone."""
    raw = keys.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, size = at[:-1][order], size[order]
    h = np.full(len(order), offset, kind)
    k = 0
    while (live := int(np.searchsorted(-size, -k, side="left"))) > FEW:
        h[:live] = (h[:live] ^ data[start[:live] + k]) * kind(prime)
        k += 1
    mask = (1 << 8 * h.itemsize) - 1
    for j in range(live):
        x = int(h[j])
        for c in data[start[j] + k : start[j] + size[j]].tolist():
            x = (x ^ c) * prime & mask
        h[j] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def _longs(h: np.ndarray, keys: pa.Array) -> pa.Array:
    return pa.array(h.astype(np.int64) if h.itemsize < 8 else h.view(np.int64), mask=keys.is_null().to_numpy(zero_copy_only=False))


@arrow_udf(LongType())
def _fnv32(keys: pa.Array) -> pa.Array:
    return _longs(fnv1a(keys, FNV32_OFFSET, FNV32_PRIME, np.uint32), keys)


@arrow_udf(LongType())
def _fnv64(keys: pa.Array) -> pa.Array:
    return _longs(fnv1a(keys, FNV64_OFFSET, FNV64_PRIME, np.uint64), keys)


def fnv32(key: Column) -> Column:
    """FNV-1a of 32 bits, as a long from 0 to 2**32 - 1; null stays null. Spark has no wrapping product of words, so it is an
    Arrow function over whole columns."""
    return _fnv32(key.cast("string"))


def fnv64(key: Column) -> Column:
    """FNV-1a of 64 bits as a signed long; null stays null."""
    return _fnv64(key.cast("string"))


def bucket_of(key: Column, n: int) -> Column:
    """The bucket of a key among n."""
    if n <= 0:
        raise ValueError("the number of buckets must be positive")
    return F.pmod(fnv32(key), F.lit(n)).cast("int")


def mixed(h: np.ndarray) -> np.ndarray:
    """An avalanche finaliser of 64 bits (xor-shift and multiply, two rounds)."""
    h = h.astype(np.uint64)
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


@arrow_udf(LongType())
def mix64(h: pa.Array) -> pa.Array:
    """mixed() of a signed long column; null stays null."""
    return _longs(mixed(h.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)), h)
