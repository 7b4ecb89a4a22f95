import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import nearpairs, neighbours, radius
from tessera.operators.nearpairs import Tables

COUNTED = ["candidate_ratio", "candidate_stats"]


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "pos long, x double, y double, z double")


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    ("rows", "threshold", "want"),
    [
        ([], 1.0, []),
        ([(1, 1, 1)], 1.0, []),
        ([(1, 1, 1), (1, 1, 1)], 0.01, [(0, 1)]),
        ([(0, 0, 0), (0.5, 0, 0)], 1.0, [(0, 1)]),
        ([(0, 0, 0), (1, 0, 0)], 1.0, []),
        ([(0, 0, 0), (0.999, 0, 0), (-1.001, 0, 0)], 1.0, [(0, 1)]),
        ([(10 * i, 0, 0) for i in range(10)] + [(0.1, 0, 0)], 0.5, [(0, 10)]),
        ([(2 * i, 2 * j, 2 * k) for i in range(5) for j in range(5) for k in range(5)], 0.9, []),
    ],
)
def test_near_pairs_of_small_sets(spark, rows, threshold, want):
    p = cloud(spark, rows)
    assert pairs(nearpairs.grid_pairs(p, threshold)) == want
    assert pairs(nearpairs.naive_pairs(p, threshold)) == want
    assert set(pairs(nearpairs.hashed_pairs(p, Tables.drawn(15, threshold), threshold))) <= set(want)


def test_near_pairs_recall_and_precision(spark):
    p = nearpairs.generated(spark, 1000, 1.5).cache()
    assert p.count() == 1000
    true = pairs(nearpairs.naive_pairs(p, 1.5))
    assert len(true) >= 100 and pairs(nearpairs.grid_pairs(p, 1.5)) == true
    t = Tables.drawn(10, 1.5)
    q = nearpairs.quality(nearpairs.hashed_pairs(p, t, 1.5), nearpairs.naive_pairs(p, 1.5)).first()
    assert q["recall"] >= 0.9 and q["precision"] == 1.0
    s = nearpairs.candidate_stats(p, t).first()
    assert s["total_candidates"] >= s["unique_candidates"] >= q["found"]
    assert nearpairs.generated(spark, 0, 1.0).count() == 0
    index, made = nearpairs.stored(spark, t, 1.5), []
    for batch, cut in enumerate(("pos < 300", "pos >= 300 and pos < 310", "pos >= 310")):
        made += pairs(nearpairs.add(index, p.where(cut), batch))
    assert sorted(made) == pairs(nearpairs.hashed_pairs(p, t, 1.5))
    m = nearpairs.metrics(spark, 300, 1.5, [11, 17]).first()
    assert m["seeds"] == 2 and m["recall_mean"] >= 0.8 and m["precision_mean"] == 1 and m["precision_std"] == 0 and 0 < m["candidate_ratio_mean"] < 1 and m["speedup_mean"] > 0
    with pytest.raises(ValueError):
        Tables.drawn(3, 0.0)
    with pytest.raises(ValueError):
        nearpairs.grid_pairs(p, 0)


def test_pairs_of_classes_sharing_no_cell(monkeypatch):
    """By columns, by every pair, and by both, with numbers of one and of many."""
    rng = np.random.default_rng(2)
    for most in (1, 9, 1 << 24):
        cells, n = [rng.integers(0, k, 300).astype(np.int16) for k in (3, 5, 2, 4)], rng.integers(1, most + 1, 300)
        want = sum(int(n[i]) * int(n[j]) for i in range(300) for j in range(i) if all(c[i] != c[j] for c in cells))
        for each in (0, 4, 1 << 20):
            monkeypatch.setattr(nearpairs, "EACH", each)
            monkeypatch.setattr(nearpairs, "PRODUCTS", 5000)
            assert nearpairs._apart(cells, n) == want


@pytest.mark.parametrize("name", COUNTED)
def test_candidates_are_counted_not_made(spark, name):
    """Points with copies, without coordinates and far off; a count has no join of rows."""
    rng = random.Random(5)
    rows = [tuple(rng.gauss(0, 1.2) for _ in "xyz") for _ in range(200)]
    rows += rows[:50] * 3 + [(1e6, 0.0, 0.0), (-1e6, 2.0, 1e5)]
    p = cloud(spark, rows).union(spark.createDataFrame([(900, 0.0, None, 0.0), (901, None, None, None)], "pos long, x double, y double, z double"))
    for count in (1, 2, 10):
        t = Tables.drawn(count, 0.5)
        got = getattr(nearpairs, name)(p, t)
        assert got.first()["unique_candidates"] == nearpairs.candidates(p, t).count() > 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "HashJoin" not in plan
    assert getattr(nearpairs, name)(p.limit(0), t).first()["unique_candidates"] == 0


def test_codes_tell_rows_apart():
    """In narrow ranges, and in those that no product of spans has room for."""
    rng = np.random.default_rng(4)
    for most in (3, 1 << 40, (1 << 63) - 1):
        values = rng.integers(-most, most, 4)
        values[:2] = -most, most
        cells = rng.choice(values, (500, 3))
        want = np.unique(cells, axis=0, return_inverse=True)[1].ravel()
        for made in (nearpairs._codes(cells), nearpairs._numbers(cells)):
            assert len(set(zip(want.tolist(), made.tolist()))) == len(set(want.tolist())) == len(set(made.tolist()))


def test_many_small_cells_are_counted_together(spark, monkeypatch):
    """A pass over batches that cut cells anywhere: no call for each cell, nothing joined, points without coordinates as in SQL."""
    p = nearpairs.generated(spark, 1500, 0.5).union(spark.createDataFrame([(9000 + k, None, 1.0, 0.0) for k in range(4)], "pos long, x double, y double, z double"))
    t = Tables.drawn(5, 0.5)
    p = p.union(p.where("pos < 40").selectExpr("pos + 10000", "x", "y", "z")).cache()
    each = nearpairs.cells(p, t).groupBy("t", "c0", "c1", "c2").count().collect()
    want = (sum(r["count"] * (r["count"] - 1) // 2 for r in each), nearpairs.candidates(p, t).count())
    plan = nearpairs.candidate_stats(p, t)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan and want[0] - 5 * 6 > want[1] > 0
    for rows in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            assert tuple(nearpairs.candidate_stats(p, t).first()) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    p.unpersist()
    rng = np.random.default_rng(6)
    rows = sorted((int(k), *map(int, c), list(map(int, e[: 3 * k])), int(n)) for k, c, e, n in zip(rng.integers(0, 3, 400), rng.integers(-1, 2, (400, 3)), rng.integers(0, 2, (400, 6)), rng.integers(1, 5, 400)))
    table = pa.table({k: pa.array(v, pa.list_(pa.int64()) if k == "earlier" else pa.int64()) for k, v in zip(("t", "c0", "c1", "c2", "earlier", "n"), zip(*rows))})
    pairs_of = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[:4] == b[:4]]
    apart = sum(a[5] * b[5] for a, b in pairs_of if all(a[4][k : k + 3] != b[4][k : k + 3] for k in range(0, 3 * a[0], 3))) + sum(r[5] * (r[5] - 1) // 2 for r in rows if not r[0])
    total = sum(a[5] * b[5] for a, b in pairs_of) + sum(r[5] * (r[5] - 1) // 2 for r in rows)
    for together in (0, 5, 64):
        monkeypatch.setattr(nearpairs, "TOGETHER", together)
        for size in (1, 7, 400):
            parts = [nearpairs._counted(*x) for x in nearpairs._whole(table.to_batches(size), ["t", "c0", "c1", "c2"])]
            assert tuple(map(sum, zip(*parts))) == (total, apart)


def inside(points, centres):
    out = []
    for q, lat, lng, r in centres:
        for i, a, b in points:
            if r < 0:
                continue
            h = math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a)) * math.sin(math.radians(b - lng) / 2) ** 2
            if r >= math.pi * 6371000 or h <= math.sin(r / 2 / 6371000) ** 2:
                out.append((q, i))
    return sorted(out)


def test_radius_joins_agree(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(2000)] + [(5000, 0.0, 179.95), (5001, 0.0, -179.95), (5002, 0.8990, 0.0), (5003, 90.0, 0.0), (5004, -90.0, 17.0), (5005, 0.0, -180.0)]
    qs = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(1e3, 4e6)) for i in range(60)]
    qs += [(100, 0.0, 179.99, 2e4), (101, 0.0, 0.0, 1e5), (102, 89.5, 10.0, 3e5), (103, 0.0, 10.0, 19.99e6), (104, 0.0, 0.0, 4e7), (105, 10.0, 10.0, -5.0), (106, 80.0, 80.0, 100.0), (107, -89.9, -170.0, 2e6)]
    p, q = spark.createDataFrame(pts, "id long, lat double, lng double"), spark.createDataFrame(qs, "qid long, lat double, lng double, radius_m double")
    want = inside(pts, qs)
    assert (100, 5000) in want and (100, 5001) in want and (101, 5002) in want
    assert pairs(radius.naive(p, q)) == want
    for degrees in (0.9, 7.0, 50.0):
        assert pairs(radius.over_cells(p, q, degrees)) == want
    assert pairs(radius.over_bands(p, q, 2.0)) == want
    for depth in (0, 1, 5):
        assert pairs(radius.over_tree(p, q, depth)) == want
    grid = radius.stored(spark, 7.0)
    radius.add(grid, p.where("id < 700"), 0)
    radius.add(grid, p.where("id >= 700 and id < 900"), 1)
    assert pairs(radius.find(grid, q)) == [x for x in want if x[1] < 900]
    radius.add(grid, p.where("id >= 700"), 1)
    assert pairs(radius.find(grid, q)) == want
    tree = radius.planted(p.where("id < 700"), 4)
    assert pairs(radius.found(tree, q)) == [x for x in want if x[1] < 700]
    radius.plant(tree, p.where("id >= 700"), 1)  # points beyond the first ones' boxes too
    assert pairs(radius.found(tree, q)) == want
    with pytest.raises(ValueError):
        radius.over_cells(p, q, 0)


def test_odd_coordinates(spark):
    p = spark.createDataFrame([(1, 95.0, 540.0), (2, 0.0, float("inf")), (3, float("nan"), 0.0), (4, None, 0.0), (5, -12.5, -190.25)], "id long, lat double, lng double")
    assert [tuple(r) for r in radius.normal(p).orderBy("id").collect()] == [(1, 90.0, -180.0), (5, -12.5, 169.75)]


SHUFFLED = ["geo_bbox_prune", "geo_radius_grid", "geo_kd_tree", "geo_radius_naive"]


@pytest.mark.parametrize("name", SHUFFLED)
def test_radius_joins_are_dealt_out(spark, sf, name):
    """A small file holds many pairs: no side is broadcast to the one task that reads the other."""
    from tessera.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert name == "geo_radius_naive" or "SortMergeJoin" in plan


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    """Points of one cell, band and leaf, a copy of each, in pieces of four."""
    monkeypatch.setattr(radius, "CROWD", 4)
    pts = [(i % 40, 10 + i % 40 / 100, 20 + i % 7 / 100) for i in range(80)]
    qs = [(i, 10.0 + i / 50, 20.0, 1e4 * i) for i in range(10)]
    p, q = spark.createDataFrame(pts, "id long, lat double, lng double"), spark.createDataFrame(qs, "qid long, lat double, lng double, radius_m double")
    want = inside(pts, qs)
    assert len(want) > 100
    for strategy in radius.STRATEGIES:
        found = radius.search(p, q, strategy)
        assert pairs(found) == want
        assert strategy == "naive" or "piece" in found._jdf.queryExecution().executedPlan().toString()


def test_radius_ties(spark):
    """Points on their centre, and those whose distance tells only after the seventh digit, a copy of each."""
    pts = [(i, lat, 179.99999995 if i % 3 else 20.0) for i, lat in enumerate([0.0, 0.0, 1e-7, -3e-7, 60.0, 60.0000001, 90.0, -90.0])]
    pts += [(i + 100, *at) for i, *at in pts]
    qs = [(10 * i + j, lat, lng, r) for i, lat, lng in pts[:8] for j, r in enumerate((0.0, 0.005, 0.02, 0.05, 1e3, 2.1e7))]
    p, q = spark.createDataFrame(pts, "id long, lat double, lng double"), spark.createDataFrame(qs, "qid long, lat double, lng double, radius_m double")
    want = inside(pts, qs)
    assert len(want) > len(qs) * 2
    for strategy in radius.STRATEGIES:
        assert pairs(radius.search(p, q, strategy)) == want


def nearest(x, q, k, ids):
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(2)
    return [[ids[j] for j in sorted(range(len(x)), key=lambda j: (d[i, j], ids[j]))[:k]] for i in range(len(q))]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([rng.normal(size=(400, 16)) + middle[rng.integers(0, 12, 400)], np.ones((20, 16))])
    ids = [1000 - i for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(1, None), (2, [float("nan")] * 16), (None, [0.0] * 16)], "vec_id long, embedding array<double>").repartition(3)
    base = neighbours.vectors(df, "vec_id", "embedding").cache()
    k = 10
    found = {}
    for r in neighbours.exact(base, base, k).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["id"])
    assert [found[i] for i in ids] == nearest(x, x, k, ids)
    true = neighbours.exact(base, base, k)
    recall = lambda got: neighbours.recall(got, true, k).first()["recall"]
    index = neighbours.trained(base, 8)
    assert recall(neighbours.by_lists(base, base, k, index, 8)) == 1.0
    assert recall(neighbours.by_lists(base, base, k, index, 2)) >= 0.8
    coded = neighbours.trained(base, 8, 8)
    assert recall(neighbours.by_lists(base, base, k, coded, 8)) >= 0.9
    asked = neighbours.inverted(base, coded)
    some = base.where("id % 7 = 0")
    again = neighbours.recall(neighbours.probe(asked, some, k, 8), true.join(some.select(F.col("id").alias("qid")), "qid"), k).first()
    assert again["recall"] >= 0.9 and again["wanted"] == k * some.count()
    few, many = (recall(neighbours.by_signs(base, base, k, rng.normal(size=(n, 16)))) for n in (8, 256))
    assert few < many and many >= 0.5
    assert neighbours.code_bytes(base, bits=64).first()[0] == 16 * base.count()
    assert neighbours.code_bytes(base, coded).first()[0] > 16 * base.count()
    with pytest.raises(ValueError):
        neighbours.trained(base, 4, 5)
    assert neighbours.exact(base, base.limit(0), k).collect() == []
    assert neighbours.generated(spark, 7, 3).count() == 7


def test_order_statistics_and_strategies(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([rng.uniform(-90, 90), 5.0]), 0.0) for i in range(500)]
    df = spark.createDataFrame([*rows, (900, None, 0.0)], "id long, lat double, lng double")
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    for k in (0, 1, 250, 499):
        assert tuple(radius.kth(df, "lat", k).first()) == want[k]
    assert radius.kth(df, "lat", 500).count() == 0
    q = spark.createDataFrame([(1, 0.0, 0.0, 1e6)], "qid long, lat double, lng double, radius_m double")
    assert len({tuple(pairs(radius.search(df, q, s))) for s in radius.STRATEGIES}) == 1


def test_sweep(spark):
    from tessera.plans import measure, sweep

    base = neighbours.generated(spark, 300, 8).cache()
    queries = base.where("id % 10 = 0")
    truth = neighbours.exact(base, queries, 5)
    table = truth.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("n")).select("qid", F.transform("n", lambda x: x["id"]).alias("neighbors")).cache()
    assert sweep.valid(base, queries, table, 30, 5) and not sweep.valid(base, queries, table, 31, 5) and not sweep.valid(base, queries, table, 30, 6)
    rows = sweep.sweep(base, queries, sweep.true_rows(table, 5), 5, bits=(16,), lists=(4, 400), parts=(0, 4, 3), probes=(1, 4, 8))
    got = {r["name"]: r for r in rows.collect()}
    assert set(got) == {"LSH 16", "IVF 4 1", "IVF 4 4", "IVFPQ 4 4 1", "IVFPQ 4 4 4"}
    assert got["IVF 4 4"]["recall"] == 1.0 and got["LSH 16"]["index_bytes"] == 300 * 10
    assert measure.best_score(rows).count() == 1


def test_loads(spark):
    from tessera.operators import keyed

    assert [keyed.next_power_of_two(n) for n in (0, 1, 2, 3, 64, 65)] == [1, 1, 2, 4, 64, 128]
    assert keyed.partition_count(5) == 64 and keyed.partition_count(100) == 128
    w = keyed.workload(spark, 1000, 50).cache()
    r = keyed.load_report(w.repartition(4)).first()
    assert (r["partitions"], r["rows"], r["load_factor"]) == (4, 1000, 250.0)
    state = {}
    for x in w.orderBy("seq").collect():
        if x["op"] == 1:
            state[x["key"]] = x["value"]
        elif x["op"] == 2:
            state.pop(x["key"], None)
    assert dict(keyed.replay(w.where("op <> 0")).collect()) == state


def test_tiles_split_groups_and_merge_level_by_level(spark, monkeypatch):
    from tessera.operators import tiles

    for name, v in (("TILE", 64), ("RUN", 2), ("BRANCH", 2), ("HELD", 50)):
        monkeypatch.setattr(tiles, name, v)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 4, 4).astype(float).tolist()) for i in range(150)] + [(200 + i, [float(i), 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    base = neighbours.vectors(df, "vec_id", "embedding").cache()
    found = {}
    for r in neighbours.exact(base, base, 6).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append((r["distance"], r["id"]))
    for i, v in rows:
        assert found[i] == sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in rows if len(w) == len(v))[:6]
