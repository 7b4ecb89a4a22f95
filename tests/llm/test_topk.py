import math

import numpy as np
import pytest

from tessera.llm.topk import top_products
from tessera.operators import tiles


def brute(rows, every, k):
    vs = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, v) for i, v in vs if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vs if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_like_brute_force(spark, monkeypatch):
    for name, v in (("TILE", 40), ("RUN", 3), ("BRANCH", 2), ("HELD", 30)):
        monkeypatch.setattr(tiles, name, v)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, None), (301, [1.0] * 7 + [None]), (302, [1.0] * 7 + [float("nan")]), (303, [float("inf")] * 8), (None, rows[0][1]), (310, [1.0, 2.0]), (311, [3.0, 1.0]), (320, []), rows[5], rows[10]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for every, k in ((10, 5), (10, 1)):
        assert sorted(map(tuple, top_products(df, every=every, k=k).collect())) == brute(rows, every, k)


def test_large_components_and_empty(spark):
    rows = [(i, [float(10**i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = df.where("vec_id < 6")
    assert sorted(map(tuple, top_products(small, every=2, k=3).collect())) == brute(rows[:6], 2, 3)
    assert top_products(df).count() == 5
    assert top_products(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        top_products(spark.createDataFrame([(0, [1e17]), (50, [1e17])], "vec_id long, embedding array<double>"))


def test_many_rows_of_one_query_id(spark):
    rng = np.random.default_rng(5)
    hot = [8.0] * 4
    rows = [(50, hot)] * 40 + [(50, [-8.0] * 4)] * 3 + [(1 + i, np.round(rng.normal(size=4), 2).tolist()) for i in range(45)]
    for scale in (1.0, 1e5):  # whole doubles, then 64-bit integers
        scaled = [(i, [x * scale for x in v]) for i, v in rows]
        df = spark.createDataFrame(scaled, "vec_id long, embedding array<double>").coalesce(1)
        got = sorted(map(tuple, top_products(df).collect()))
        assert len(got) == 10 and got == brute(scaled, 50, 5)
