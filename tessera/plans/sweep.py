"""A sweep of approximate searches over their parameters: recall, build and search time and index size of each configuration."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import neighbours

#: The published grid of a sweep, for a base of a million vectors.
PUBLISHED = {"bits": (32, 64, 96, 128, 192, 256), "lists": (256, 1024, 4096), "parts": (8, 16, 32), "probes": (1, 4, 8, 16, 32, 64)}
SCHEMA = "name string, recall double, build_s double, search_ms_per_q double, search_ms_stdev double, index_bytes long"


def valid(base: DataFrame, queries: DataFrame, truth: DataFrame, least_queries: int, least_truth: int) -> bool:
    """Whether all vectors have one width, there are enough queries, and each has enough true neighbours."""
    widths = base.select(F.size("vec").alias("w")).union(queries.select(F.size("vec"))).distinct().limit(2).count()
    short = truth.where(F.col("neighbors").isNull() | (F.size("neighbors") < least_truth)).limit(1).count()
    return widths == 1 and not short and queries.count() >= least_queries and truth.count() >= least_queries


def true_rows(truth: DataFrame, k: int) -> DataFrame:
    """(qid, id) of the first k true neighbours of each query."""
    return truth.select("qid", F.explode(F.slice("neighbors", 1, k)).alias("id"))


def timed(search: Callable[[], DataFrame], queries: int, times: int) -> tuple[float, float]:
    """Mean and sample deviation of milliseconds a query over runs of the whole search; no deviation for one run."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        search().write.format("noop").mode("overwrite").save()
        took.append((time.perf_counter() - began) * 1000 / max(1, queries))
    return float(np.mean(took)), float(np.std(took, ddof=1)) if times > 1 else 0.0


def sweep(base: DataFrame, queries: DataFrame, truth: DataFrame, k: int, bits=(32, 64), lists=(16,), parts=(0, 8), probes=(1, 4), times: int = 2, seed: int = 0) -> DataFrame:
    """A row for each configuration. Parts of 0 keep whole vectors; parts that don't divide the width, more probes than lists, and
    lists with under 64 training vectors each are left out."""
    spark, width, n = base.sparkSession, base.first()["vec"], queries.count()
    width, sample = len(width), min(base.count(), neighbours.SAMPLE)
    rows = []

    def add(name, build, run, size):
        began = time.perf_counter()
        made = build()
        built = time.perf_counter() - began
        ms, sd = timed(lambda: run(made), n, times)
        found = neighbours.recall(run(made), truth, k).first()["recall"]
        rows.append((name, float(found), built, ms, sd, size(made).first()[0]))

    for b in bits:
        add(f"LSH {b}", lambda b=b: np.random.default_rng(seed).normal(size=(b, width)), lambda d: neighbours.by_signs(base, queries, k, d), lambda d: neighbours.code_bytes(base, bits=-(-len(d) // 8) * 8))
    for m in lists:
        for p in parts:
            if 64 * m > sample or p and width % p:
                continue
            for probe in probes:
                if probe <= m:
                    name = f"IVFPQ {m} {p} {probe}" if p else f"IVF {m} {probe}"
                    add(name, lambda m=m, p=p: neighbours.inverted(base, neighbours.trained(base, m, p, seed)), lambda i, probe=probe: neighbours.probe(i, queries, k, probe), lambda i: neighbours.code_bytes(base, i.lists))
    return spark.createDataFrame(rows, SCHEMA)
