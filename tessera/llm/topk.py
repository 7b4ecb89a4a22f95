"""Exact top-k inner products: tiles of a matrix product, partial selection per tile, top lists merged as a tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tiles import best_pairs, matrix, merged, most_tiles, parts, tiled
from .common import written

LAST = np.iinfo(np.int64).max


def levels(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v, size): floor(scale * x) of each component, of vectors without null or non-finite parts, and the largest of them."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    scaled = F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y.cast("double")))
    largest = F.array_max(F.transform(x, lambda y: F.abs(F.lit(float(scale)) * y.cast("double")) + 1))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(whole)
    return rows.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"), largest.alias("size"))


def ready(batch, _):
    return batch["query_id"].to_numpy(), matrix(batch["vec"])


def select(queries, batch, _, best) -> None:
    """Puts a tile of the product into the lists: only scores that reach a list's end and the tile's own k-th.

    Keys are complements of scores, so that the smallest come first. Rows of a query's id, however many, are no candidates and
    count as last before the k-th is taken.
    """
    names, q = queries
    ids, x = batch["id"].to_numpy(), matrix(batch["vec"]).T
    for p in parts(len(q), len(ids)):
        key = ~(q[p] @ x).astype(np.int64)
        other = ids[None, :] != names[p][:, None]
        key[~other] = LAST
        bound = best.worst[p]
        if len(ids) > best.k:
            bound = np.minimum(bound, np.partition(key, best.k - 1, axis=1)[:, best.k - 1])
        row, col = np.nonzero((key <= bound[:, None]) & other)
        best.add(row + p.start, key[row, col], ids[col])


def top_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): for each query, a vector whose id every divides, its k best other vectors.

    Scores are integer inner products of floor(scale * x); where they could exceed 64 bits, ValueError is raised. Queries and
    vectors are tiles in the shared folder; a task multiplies a tile of queries with a run of tiles of vectors and keeps k rows
    of a query, and the lists of runs are merged as a tree. Vectors that are null or hold null or non-finite parts, and null ids,
    take no part. Vectors pair with those of their own length only. Repeated rows: each is a candidate of its own; of equal query
    rows one stays; rows of the query's id are never its candidates. Ties: the smaller id. Fewer than k candidates: all. Empty
    table: no rows. Other columns are not read.
    """
    rows = written(levels(vectors, id_col, vec_col, scale), "levels")
    query = F.col("id") % every == 0
    about = rows.agg(F.max(F.size("v")).alias("d"), F.max("size").alias("m"), F.max(F.when(query, F.col("size"))).alias("q")).first()
    most = (about["d"] or 1) * (about["m"] or 0.0) * (about["q"] or 0.0)
    if most >= 2.0**63 or (about["m"] or 0.0) >= 2.0**62:
        raise ValueError("inner products of these vectors exceed 64 bits")
    kind = "array<double>" if most < 2.0**53 else "array<long>"  # then every partial sum is a whole double
    vec = F.col("v").cast(kind).alias("vec")
    grp = F.size("v").cast("long").alias("grp")
    asked = rows.where(query).select("id", "v").distinct().select(grp, F.col("id").alias("query_id"), F.xxhash64("id", "v").alias("key"), vec)
    tiles = tiled(rows.select(grp, "id", vec).sortWithinPartitions("grp"))
    found = best_pairs(tiled(asked.sortWithinPartitions("grp")), tiles, k, np.int64, "query_id long, key long", ready, select)
    best = merged(found, ["query_id", "key"], k, most_tiles(tiles))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.bitwise_not("score").alias("score"))
