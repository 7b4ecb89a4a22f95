import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import bucket_of, fnv32, fnv64, mix64, mixed
from tessera.operators import keyed, static
from tessera.session import shared_path
from tessera.sources import oplog

ODD = ["", " ", "a\tb", "a\nb", "ключ", "中", "k" * 5000, "A", "a"]


def fnv(data, bits):
    offset, prime = (2166136261, 16777619) if bits == 32 else (14695981039346656037, 1099511628211)
    for b in data:
        offset = (offset ^ b) * prime % (1 << bits)
    return offset


def test_hashes(spark):
    df = spark.createDataFrame([(k,) for k in ODD], "k string")
    for r in df.select("k", fnv32(F.col("k")).alias("a"), fnv64(F.col("k")).alias("b"), bucket_of(F.col("k"), 7).alias("c"), mix64(fnv64(F.col("k"))).alias("d")).collect():
        data = r["k"].encode()
        assert r["a"] == fnv(data, 32) and r["b"] % 2**64 == fnv(data, 64) and r["c"] == fnv(data, 32) % 7
        assert r["d"] % 2**64 == int(mixed(np.array([fnv(data, 64)], np.uint64))[0])
    with pytest.raises(ValueError):
        bucket_of(F.col("k"), 0)


def model(seed, n=2500, keys=128):
    rng, state, rows = random.Random(seed), {}, []
    for seq in range(n):
        k, kind = f"key{rng.randrange(keys)}", rng.choice("ssdg")
        if kind == "s":
            state[k] = f"v{seq}"
            rows.append((seq, 1, k, state[k]))
        elif kind == "d":
            state.pop(k, None)
            rows.append((seq, 2, k, None))
    return rows, state


def test_replay_and_upserts_follow_a_map(spark):
    rows, state = model(42)
    log = spark.createDataFrame(rows, "seq long, op int, key string, value string")
    assert dict(keyed.replay(log).collect()) == state
    half = keyed.replay(log.where("seq < 1200"))
    assert {r["key"]: r["value"] for r in keyed.upsert(half, log.where("seq >= 1200")).collect()} == state
    probes = spark.createDataFrame([(k,) for k in [*list(state)[:5], "none", None]], "key string")
    got = {r["key"]: (r["value"], r["found"]) for r in keyed.lookup(keyed.replay(log), probes).collect()}
    assert got == {k: (state.get(k), k in state) for k in got}


def test_binary_log_keeps_odd_strings_and_compacts(spark):
    rows, state = model(7, 600, 30)
    rows += [(10_000 + i, 1, k, "значение\n" * i) for i, k in enumerate(ODD)] + [(20_000, 2, "missing", None)]
    state |= {k: "значение\n" * i for i, k in enumerate(ODD)}
    log = spark.createDataFrame(rows, "seq long, op int, key string, value string")
    path = shared_path(spark, "t")
    oplog.append(log.where("seq < 300"), path, 8)
    oplog.append(log.where("seq >= 300"), path, 8)
    back = oplog.read(spark, path)
    assert back.count() == len(rows)
    assert dict(keyed.replay(back).collect()) == state
    other = shared_path(spark, "t")
    oplog.append(oplog.compacted(back), other, 8)
    again = oplog.read(spark, other)
    assert again.count() == len(state) and dict(keyed.replay(again).collect()) == state
    with pytest.raises(Exception, match="8 buckets"):
        oplog.append(log, path, 16)
    for bad in ((1, 1, None, "v"), (1, 1, "k", None)):
        with pytest.raises(Exception, match="can't be kept"):
            oplog.append(spark.createDataFrame([bad], "seq long, op int, key string, value string"), path, 8)
    assert dict(keyed.replay(oplog.read(spark, path)).collect()) == state
    oplog.clear(spark, path, 8)
    assert oplog.read(spark, path).count() == 0 and keyed.cleared(log).count() == 0 and keyed.cleared(log).columns == log.columns


def test_a_hot_bucket_is_written_and_read_by_several_tasks(spark, monkeypatch):
    log = spark.range(5000).select(F.col("id").alias("seq"), F.lit(1).alias("op"), F.lit("hot").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    path = shared_path(spark, "hot")
    oplog.append(log.repartition(3), path, 4)
    back = oplog.read(spark, path)
    assert back.rdd.getNumPartitions() > 1
    assert [(r["seq"], r["value"]) for r in back.orderBy("seq").collect()] == [(i, f"v{i}") for i in range(5000)]
    assert keyed.replay(back).collect() == [("hot", "v4999")]


def test_damaged_logs_are_refused():
    import io

    whole = oplog.record(1, b"key", b"value")
    assert list(oplog.records(io.BytesIO(whole * 2))) == [(1, "key", "value")] * 2
    for cut in (3, len(whole) - 1):
        with pytest.raises(EOFError):
            list(oplog.records(io.BytesIO(whole + whole[:cut])))
    with pytest.raises(ValueError):
        list(oplog.records(io.BytesIO(struct.pack("<BII", 9, 1, 0) + b"k")))


def test_stats_and_compaction(spark):
    rows = [(i, 1, "a", str(i)) for i in range(70)] + [(100, 1, "b", "x"), (101, 2, "b", None)]
    log = spark.createDataFrame(rows, "seq long, op int, key string, value string")
    stats = keyed.bucket_stats(log, 1)
    assert [tuple(r) for r in stats.collect()] == [(0, 72, 1, 71)]
    assert keyed.compaction_candidates(stats).count() == 1 and keyed.compaction_candidates(stats, 100).count() == 0


def test_merges(spark):
    rows = [(w, s, f"k{s % 64:07d}", 1) for w in range(12) for s in range(400)]
    df = spark.createDataFrame(rows, "worker int, seq long, key string, value long")
    got = {r["key"]: r["value"] for r in keyed.merge(df, "key", F.sum("value")).collect()}
    assert sum(got.values()) == 4800 and len(got) == 64
    one = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("b", 1, 9)], "key string, seq long, value long")
    told = {r["key"]: r["value"] for r in keyed.merge_ordered(one, "key", "value", "seq", lambda a, b: a * 10 + b).collect()}
    assert told == {"a": 35, "b": 9}
    run = keyed.merge_running(df.where("key = 'k0000001'").withColumn("seq", F.col("worker") * 1000 + F.col("seq")), "key", "value", ("seq",), F.floor(F.col("seq") / 1000))
    assert sorted(r["merged"] for r in run.collect()) == list(range(1, run.count() + 1))
    assert keyed.put_last(one, "key", "value", ("seq",)).where("key = 'a'").first()["value"] == 5
    assert keyed.size(df, "key").first()[0] == 64


def test_static_tables(spark):
    dim = spark.createDataFrame([(f"prefix-{i:04d}", str(i * i)) for i in range(7000)] + [(k, k) for k in ODD[:6]], "key string, value string")
    index = static.build(dim, "key")
    rows = index.table.collect()
    assert {r["key"] for r in rows} == {r["key"] for r in dim.collect()}
    sizes = {r["shard"]: r["keys"] for r in index.function.collect()}
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((s, k) for s, n in sizes.items() for k in range(n))
    s = static.structure(index).first()
    assert s["keys"] == len(rows) and s["load_factor"] == 1 and 2 < s["bits_per_key"] < 8
    probes = spark.createDataFrame([("prefix-0003",), ("PREFIX-0003",), ("",), (None,), ("prefix-0003",)] + [(f"none-{i}",) for i in range(500)], "p string")
    got = static.get(index, probes, "p", "value").collect()
    assert len(got) == 505 and {r["p"]: (r["value"], r["found"]) for r in got if r["found"]} == {"prefix-0003": ("9", True), "": ("", True)}
    assert sum(r["found"] for r in got) == 3 and all(r["value"] is None for r in got if not r["found"])
    with pytest.raises(ValueError, match="not unique"):
        static.build(dim.union(dim.limit(1)), "key")
    assert static.duplicates(dim.union(dim.limit(2)), "key").count() == 2
    empty = static.build(dim.limit(0), "key")
    assert static.structure(empty).first()["keys"] == 0 and static.get(empty, probes, "p", "value").where("found").count() == 0
    assert sum(1 for _ in static.batches(probes)) == 505


def test_levels_place_every_key_once():
    rng = np.random.default_rng(3)
    shard = np.sort(rng.integers(0, 9, 3000))
    few = np.concatenate([shard, [20], [21, 21]])
    hashes = [rng.integers(-(2**63), 2**63 - 1, len(few)) for _ in range(static.LEVELS + 1)]
    for h in hashes[1:]:
        h[-2:] = 77  # two keys that no level tells apart are listed
    got = static.leveled(few, hashes).to_pylist()
    assert [r["keys"] for r in got] == np.unique(few, return_counts=True)[1].tolist()
    for r in got:
        ones = sum(int(w & (2**64 - 1)).bit_count() for w in r["words"])
        assert ones + len(r["rest"]) == r["keys"] and r["before"][-1] == ones and r["repeated"] is None
    assert got[-1]["rest"] == sorted(hashes[0][-2:].tolist())
    hashes[0][-2:] = 5
    assert static.leveled(few, hashes).to_pylist()[-1]["repeated"] == 5
