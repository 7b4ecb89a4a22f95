"""Static lookup tables of unique keys behind a minimal perfect hash.

Keys are dealt by hash to shards of about SHARD keys. A shard's function is a few bit vectors, one a level: a key that is alone at
its place of the first level sets its bit there, the others try the next level, and the few that LEVELS leave are listed. A key's
slot is the number of bits set before its own, so the slots of a shard are just 0 to n - 1. One shuffle by shard builds all
functions; probing is column expressions over the shard's row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv64
from ..session import written

#: Keys of a shard on average, and levels of bit vectors. A level has as many bits as keys, in whole words.
SHARD, LEVELS = 512, 8
SCHEMA = "shard long, keys int, starts array<int>, words array<long>, before array<int>, rest array<long>, repeated long"


@dataclass
class Index:
    """A perfect hash: (shard, keys, starts, words, before, rest) by shard, and the table's rows with their shard and slot."""

    function: DataFrame
    table: DataFrame | None
    shards: int
    key: str


def duplicates(dim: DataFrame, key: str) -> DataFrame:
    return dim.groupBy(key).count().where("count > 1")


def _hash(key: Column, level: int | Column) -> Column:
    return F.xxhash64(F.lit(level), key)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(_hash(key, 0), F.lit(shards))


def leveled(shard: np.ndarray, hashes: list[np.ndarray]) -> pa.RecordBatch:
    """The functions of whole shards, rows sorted by shard: hashes has a key's own hash, then one for each level."""
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    n, own = len(first), np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(shard)]])))
    left, made = np.arange(len(shard)), []
    for h in hashes[1:]:
        size = -(-np.bincount(own[left], minlength=n) // 64) * 64
        base = np.cumsum(size) - size
        place = base[own[left]] + h[left] % size[own[left]]
        hit = np.bincount(place, minlength=int(size.sum()))
        made.append((base // 64, size // 64, np.packbits(hit == 1, bitorder="little").view(np.int64)))
        left = left[hit[place] > 1]
    cuts = np.searchsorted(own[left], np.arange(n + 1))
    rest = [np.sort(hashes[0][left[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    out = [[] for _ in range(7)]
    for k, at in enumerate(first.tolist()):
        words = np.concatenate([w[b[k] : b[k] + s[k]] for b, s, w in made])
        ones = np.bitwise_count(words.view(np.uint64)).astype(np.int64)
        again = rest[k][1:][rest[k][1:] == rest[k][:-1]]
        row = (int(shard[at]), 0, np.concatenate([[0], np.cumsum([s[k] for _, s, _ in made])]).tolist(), words.tolist(), (np.cumsum(ones) - ones).tolist() + [int(ones.sum())], rest[k].tolist(), int(again[0]) if len(again) else None)
        for column, v in zip(out, row):
            column.append(v)
    out[1] = np.bincount(own, minlength=n).tolist()
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def perfect_hash(dim: DataFrame, key: str, shards: int | None = None) -> Index:
    """The function alone, written. Null keys take no part. Raises ValueError on a repeated key, which no level can tell apart."""
    shards = shards or max(1, -(-dim.count() // SHARD))
    k = F.col(key)
    rows = dim.where(k.isNotNull()).select(_shard(k, shards).alias("shard"), *[_hash(k, j).alias(f"h{j}") for j in range(LEVELS + 1)])

    def build(batches):
        held = None
        for b in batches:
            now = [c.to_numpy() for c in b.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last shard may go on in the next batch
            if cut:
                yield leveled(held[0][:cut], [x[:cut] for x in held[1:]])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield leveled(held[0], held[1:])

    function = written(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, SCHEMA), "perfect_hash")
    again = function.where("repeated is not null").limit(1).collect()
    if again:
        some = dim.where(_hash(k, 0) == again[0]["repeated"]).select(key).first()
        raise ValueError(f"key {some[0]!r} is not unique")
    return Index(function.drop("repeated"), None, shards, key)


def _slot(key: Column) -> Column:
    """The slot of a key beside its shard's function: where its first set bit stands; null if it is surely no key."""
    ones, own = F.element_at("before", -1), _hash(key, 0)

    def tried(found: Column, level: Column) -> Column:
        start = F.element_at("starts", level)
        words = F.element_at("starts", level + 1) - start
        at = F.pmod(_hash(key, level), (words * 64).cast("long"))
        word, bit = start + F.shiftright(at, 6).cast("int") + 1, at.bitwiseAND(F.lit(63)).cast("int")
        here = F.element_at("words", word)
        lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
        mine = F.when((words > 0) & (F.getbit(here, bit) == 1), F.element_at("before", word) + F.bit_count(here.bitwiseAND(lower)))
        return F.when(found.isNotNull(), found).otherwise(mine)

    # A loop over levels, most of which it passes by: as code for each level it would be too long to be compiled.
    found = F.aggregate(F.array(*[F.lit(k) for k in range(1, LEVELS + 1)]), F.lit(None).cast("int"), tried)
    return F.coalesce(found, F.when(F.array_contains("rest", own), ones + F.array_position("rest", own).cast("int") - 1))


def slots(index: Index, rows: DataFrame, key: str) -> DataFrame:
    """rows with _shard and _slot of their key; _slot is null for a null key and where the function shows that there is no such key."""
    k = F.col(key)
    asked = rows.withColumn("_shard", _shard(k, index.shards))
    held = index.function.select(F.col("shard").alias("_shard"), "starts", "words", "before", "rest")
    found = asked.join(held, "_shard", "left")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], "_shard", F.when(k.isNotNull() & F.col("words").isNotNull(), _slot(k)).alias("_slot"))


def build(dim: DataFrame, key: str, values: list[str] | None = None, shards: int | None = None) -> Index:
    """A perfect hash of the keys and the table in its slots: (shard, slot, key, values). Raises ValueError on a repeated key."""
    index = perfect_hash(dim, key, shards)
    kept = [key, *(values if values is not None else [c for c in dim.columns if c != key])]
    table = slots(index, dim.where(F.col(key).isNotNull()).select(*kept), key).withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    return Index(index.function, written(table, "slots"), index.shards, key)


def get(index: Index, probes: DataFrame, probe: str, value: str) -> DataFrame:
    """Probes with the value of their key, and whether it is there: a probe's slot is worked out, and the key that the slot holds
    is compared, so one that was never a key is not found. Spark broadcasts function and table while it sees that they are small."""
    asked = slots(index, probes, probe)
    held = index.table.select(F.col("shard").alias("_s"), F.col("slot").alias("_t"), F.col(index.key).alias("_k"), F.col(value).alias("value"), F.lit(True).alias("_f"))
    same = (F.col("_shard") == F.col("_s")) & (F.col("_slot") == F.col("_t")) & (F.col(probe) == F.col("_k"))
    return asked.join(held, same, "left").select(*[F.col(f"`{c}`") for c in probes.columns], "value", F.coalesce("_f", F.lit(False)).alias("found"))


def missing(dim: DataFrame, probes: DataFrame, key: str, probe: str) -> DataFrame:
    return probes.join(dim.select(F.col(key).alias(probe)), probe, "left_anti")


def bucket_sizes(dim: DataFrame, key: str, buckets: int) -> DataFrame:
    """(size, buckets): how many buckets of a 64-bit FNV-1a hash hold so many keys."""
    each = dim.groupBy(F.pmod(fnv64(F.col(key)), F.lit(buckets)).alias("b")).count()
    return each.groupBy(F.col("count").alias("size")).agg(F.count("*").alias("buckets"))


def structure(index: Index) -> DataFrame:
    """(keys, load_factor, bits_per_key): keys for each slot, and the bits of all words, counts before words, starts and lists for each key."""
    slots_ = F.element_at("before", -1) + F.size("rest")
    bits = 64 * (F.size("words") + F.size("rest")) + 32 * (F.size("before") + F.size("starts"))
    keys = F.sum("keys")
    return index.function.agg(F.coalesce(keys, F.lit(0)).alias("keys"), (keys / F.sum(slots_)).alias("load_factor"), (F.sum(bits) / keys).alias("bits_per_key"))


def batches(rows: DataFrame) -> Iterator:
    """A snapshot's rows, a partition at a time."""
    return rows.toLocalIterator()
