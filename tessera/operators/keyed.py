"""Keyed tables: an operation log replayed to a state, lookups, bucket statistics, compaction, and merges of values by key."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket_of

SET, DELETE = 1, 2
#: A bucket is compacted once it holds so many records and more stale ones than live ones.
LEAST_RECORDS = 64


def replay(log: DataFrame, key: str = "key", value: str = "value", op: str = "op", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(key, value) of each key whose last operation sets it. Null keys are a key like any other. One partial aggregate, one shuffle."""
    last = F.max_by(F.struct(F.col(op).alias("op"), F.col(value).alias("value")), F.struct(*order))
    return log.groupBy(F.col(key).alias("key")).agg(last.alias("last")).where(F.col("last.op") == SET).select("key", "last.value")


def lookup(state: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """Every probe with the state's value and whether it was found."""
    held = state.select(F.col("key").alias("_k"), F.col("value"), F.lit(True).alias("_f"))
    return probes.join(held, probes[key] == held["_k"], "left").select(probes["*"], "value", F.coalesce("_f", F.lit(False)).alias("found"))


def upsert(state: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """The state after a batch of changes (key, op, value, order): untouched keys, and those that the batch sets last."""
    now = changes.groupBy("key").agg(F.max_by(F.struct("op", "value"), order).alias("last"))
    kept = state.join(now, "key", "left_anti").select("key", "value")
    return kept.unionByName(now.where(F.col("last.op") == SET).select("key", "last.value"))


def bucket_stats(log: DataFrame, buckets: int, key: str = "key", value: str = "value", op: str = "op", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(bucket, records, live, stale): stale is all records but one for each live key, as a reload counts."""
    each = log.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"), F.max_by(F.col(op), F.struct(*order)).alias("op"))
    rows = each.select(bucket_of(F.col("key"), buckets).alias("bucket"), "n", F.when(F.col("op") == SET, 1).otherwise(0).alias("live"))
    out = rows.groupBy("bucket").agg(F.sum("n").alias("records"), F.sum("live").alias("live"))
    return out.select("bucket", "records", "live", (F.col("records") - F.col("live")).alias("stale"))


def compaction_candidates(stats: DataFrame, least: int = LEAST_RECORDS) -> DataFrame:
    return stats.where((F.col("records") >= least) & (F.col("stale") > F.col("live")))


def put_last(rows: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """The last value put for each key."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(value), F.struct(*order)).alias("value"))


def merge(rows: DataFrame, key: str, merged: Column) -> DataFrame:
    """Values of a key under an associative, commutative merger, given as an aggregate."""
    return rows.groupBy(F.col(key).alias("key")).agg(merged.alias("value"))


def merge_ordered(rows: DataFrame, key: str, value: str, order: str, merger: Callable[[Any, Any], Any]) -> DataFrame:
    """Values of a key under any merger (old, new) of Python values, in order. A merger that is not associative can't be split, so a
    key is one task's work, but its values go by one at a time: a task holds one key's merged value and a batch."""
    kinds = dict(rows.dtypes)

    def fold(batches):
        now, held, some = None, None, False
        for b in batches:
            out: list[tuple] = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if some and k == now:
                    held = merger(held, v)
                    continue
                if some:
                    out.append((now, held))
                now, held, some = k, v, True
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], []), b.schema.types)], names=["key", "value"])
            types = b.schema.types
        if some:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((now, held), types)], names=["key", "value"])

    dealt = rows.repartition(key).sortWithinPartitions(key, order)
    return dealt.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInArrow(fold, f"key {kinds[key]}, value {kinds[value]}")


def merge_running(rows: DataFrame, key: str, value: str, order: tuple[str, ...], segment: Column) -> DataFrame:
    """rows with the sum of the key's values so far. segment is monotone in the order and cuts a key's rows into groups that one
    task can sort: sums within segments are offset by sums of earlier segments, so a hot key is not sorted in one task."""
    rows = rows.withColumn("_s", segment)
    inside = F.sum(value).over(Window.partitionBy(key, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(key, "_s").agg(F.sum(value).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    offset = sums.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.coalesce(before, F.lit(0)).alias("_b"))
    told = rows.withColumn("_i", inside)
    joined = told.join(offset, told[key].eqNullSafe(offset["_k"]) & told["_s"].eqNullSafe(offset["_t"]))
    return joined.withColumn("merged", F.col("_i") + F.col("_b")).drop("_s", "_i", "_k", "_t", "_b")


def cleared(rows: DataFrame) -> DataFrame:
    """The table without its rows."""
    return rows.where(F.lit(False))


def size(rows: DataFrame, key: str) -> DataFrame:
    """Distinct keys; null is one of them if there."""
    return rows.select(key).distinct().agg(F.count("*").alias("size"))


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def partition_count(wanted: int, least: int = 64) -> int:
    """Partitions for a table: a power of two, and not fewer than least."""
    return next_power_of_two(max(wanted, least))


def load_report(rows: DataFrame) -> DataFrame:
    """(partitions, rows, load_factor, largest): how evenly a table's partitions are filled."""
    each = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    parts = rows.rdd.getNumPartitions()
    total = F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(F.lit(parts).alias("partitions"), total.alias("rows"), (total / max(1, parts)).alias("load_factor"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def workload(spark: SparkSession, n: int, keys: int, seed: int = 42, sets: float = 0.5, deletes: float = 0.25) -> DataFrame:
    """(seq, op, key, value): sets, deletes and reads (op 0) of random keys in the given shares."""
    r = F.rand(seed)
    op = F.when(F.col("r") < sets, SET).when(F.col("r") < sets + deletes, DELETE).otherwise(0)
    rows = spark.range(n).select(F.col("id").alias("seq"), r.alias("r"), F.floor(F.rand(seed + 1) * keys).cast("long").alias("k"))
    return rows.select("seq", op.alias("op"), F.format_string("k%07d", "k").alias("key"), F.when(op == SET, F.concat(F.lit("v"), F.col("seq"))).alias("value"))
