"""Nearest neighbours of dense vectors: exact, by sign codes, by inverted lists, and by product-quantised residuals.

Vectors stand in tiles of the shared folder. Every search is a table of pairs of tiles, compared as matrices (operators.tiles).
Inverted lists are assigned and written once, as tiles by list, and probed by any number of searches. There is no graph index
here: a graph walk is one long chain of dependent reads, so inverted lists with a probe count are the tunable approximate search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.blocks import sliced
from .tiles import Best, best_pairs, matrix, merged, most_tiles, parts, tiled

#: Training vectors that centroids and codebooks are fit on at most.
SAMPLE = 20_000
#: Rows by code distance, in multiples of k, whose exact distances decide.
REFINE = 30
#: Part of a product's magnitude within which distances are told apart by sums of squares.
NEAR = 1e-9


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows with an id and a vector whose parts are all there and finite."""
    whole = F.forall(F.col(vec_col), lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(whole).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, from a matrix product."""
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)


def nearest(x: np.ndarray, centre: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first; a bounded product at a time."""
    out = [np.argsort(squared(x[p], centre), axis=1, kind="stable")[:, :n] if n > 1 else squared(x[p], centre).argmin(1)[:, None] for p in parts(len(x), len(centre))]
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def closest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, best: Best, rough: Callable[[slice], np.ndarray] | None = None) -> None:
    """Puts the nearest rows of x to each query into best, by sums of squares. rough gives other distances that choose the rows."""
    k = best.k
    keep = min(len(ids), REFINE * k if rough else 2 * k + 8)
    for p in parts(len(q), len(ids)):
        d = rough(p) if rough else squared(q[p], x)
        scale = NEAR * ((q[p] * q[p]).sum(1) + (x * x).sum(1).max(initial=0)) if rough is None else np.zeros(len(d))
        bound = np.partition(d, keep - 1, axis=1)[:, keep - 1] if keep < len(ids) else np.full(len(d), np.inf)
        bound = bound if rough else np.minimum(bound, best.worst[p])
        row, col = np.nonzero(d <= (bound + scale)[:, None])  # ties at the bound stay, so the smaller id wins
        for a in range(0, len(row), 1 << 16):
            r, c = row[a : a + (1 << 16)] + p.start, col[a : a + (1 << 16)]
            value = ((q[r] - x[c]) ** 2).sum(1)
            some = value <= best.worst[r]
            best.add(r[some], value[some], ids[c[some]])


def by_width(vecs: DataFrame) -> DataFrame:
    """Tiles of vectors, grouped by their width: others don't compare."""
    return tiled(vecs.select(F.size("vec").cast("long").alias("grp"), "id", "vec").sortWithinPartitions("grp"))


def _ranked(found: DataFrame, k: int, runs: int) -> DataFrame:
    return merged(found, ["qid"], k, runs).select("qid", "rank", "id", F.col("score").alias("distance"))


def _queried(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").alias("qid"), "vec")


def _tiles_of(queries: DataFrame) -> DataFrame:
    return tiled(queries.select(F.size("vec").cast("long").alias("grp"), F.col("id").alias("qid"), "vec").sortWithinPartitions("grp"))


def exact(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, distance): the k nearest by squared distance; ties go to the smaller id. A query that is itself in the base
    finds itself. Vectors of other widths don't compare."""

    def compare(q, b, _, best):
        closest(q, matrix(b["vec"]), b["id"].to_numpy(), best)

    tiles = by_width(base)
    return _ranked(best_pairs(_tiles_of(queries), tiles, k, np.float64, "qid long", lambda b, _: matrix(b["vec"]), compare), k, most_tiles(tiles))


def signs(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Words of 64 sign bits of projections."""
    bits = x @ directions.T >= 0
    pad = np.zeros((len(x), -bits.shape[1] % 64), bool)
    return np.packbits(np.concatenate([bits, pad], axis=1), axis=1, bitorder="little").view(np.uint64)


def hamming(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        out += np.bitwise_count(q[:, k, None] ^ x[None, :, k])
    return out


def by_signs(base: DataFrame, queries: DataFrame, k: int, directions: np.ndarray) -> DataFrame:
    """(qid, rank, id, distance): the k nearest by Hamming distance of sign codes, ties to the smaller id."""

    def compare(q, b, _, best):
        codes, ids = signs(matrix(b["vec"]), directions), b["id"].to_numpy()
        for p in parts(len(q), len(ids)):
            d = hamming(q[p], codes)
            keep = min(k, len(ids))
            row, col = np.nonzero(d <= np.minimum(np.partition(d, keep - 1, axis=1)[:, keep - 1], best.worst[p])[:, None])
            best.add(row + p.start, d[row, col], ids[col])

    width = F.size("vec") == directions.shape[1]
    tiles = by_width(base.where(width))
    return _ranked(best_pairs(_tiles_of(queries.where(width)), tiles, k, np.float64, "qid long", lambda b, _: signs(matrix(b["vec"]), directions), compare), k, most_tiles(tiles))


def means(x: np.ndarray, n: int, seed: int = 0, rounds: int = 15) -> np.ndarray:
    """Centroids of at most n groups, by Lloyd's rounds from distinct rows drawn at random."""
    x = x.astype(np.float64)
    some = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centre = some[np.sort(rng.choice(len(some), min(n, len(some)), replace=False))]
    for _ in range(rounds):
        near = nearest(x, centre)[:, 0]
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        if np.allclose(new, centre):
            break
        centre = new
    return centre


@dataclass
class Lists:
    """What an inverted-list index is trained to: centroids, and for product codes a codebook for each part of the residual."""

    centroids: np.ndarray
    books: list[np.ndarray] | None = None

    def codes(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([nearest(p, b)[:, 0] for p, b in zip(np.split(residual, len(self.books), axis=1), self.books)], axis=1).astype(np.uint8)


@dataclass
class Inverted:
    """An inverted-list index: its training and the tiles of each list, written once."""

    lists: Lists
    tiles: DataFrame


def training_sample(base: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """At most so many vectors, those of the smallest hash of their id: the same ones in every run."""
    got = base.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    return matrix(got["vec"].combine_chunks())


def trained(base: DataFrame, lists: int, parts: int = 0, seed: int = 0, most: int = SAMPLE) -> Lists:
    """Raises ValueError if the width is no multiple of parts."""
    x = training_sample(base, most)
    centre = means(x, lists, seed)
    if not parts:
        return Lists(centre)
    if x.shape[1] % parts:
        raise ValueError("the vectors' width must be a multiple of the parts")
    rest = x - centre[nearest(x, centre)[:, 0]]
    return Lists(centre, [means(p, 256, seed + 1 + i) for i, p in enumerate(np.split(rest, parts, axis=1))])


def inverted(base: DataFrame, lists: Lists) -> Inverted:
    """Every vector in the list of its nearest centroid, with its product code if there are codebooks; lists are written as tiles.
    Vectors are dealt out by list, and adaptive execution splits a list that is too large for one task."""

    def assign(batches):
        for b in sliced(batches, 4096):
            x = matrix(b["vec"])
            grp = nearest(x, lists.centroids)[:, 0]
            code = [c.tobytes() for c in lists.codes(x - lists.centroids[grp])] if lists.books else [b""] * len(x)
            yield pa.record_batch([pa.array(grp), b["id"], b["vec"], pa.array(code, pa.binary())], names=["grp", "id", "vec", "code"])

    rows = base.where(F.size("vec") == lists.centroids.shape[1]).select("id", "vec").mapInArrow(assign, "grp long, id long, vec array<double>, code binary")
    return Inverted(lists, tiled(rows.hint("rebalance", "grp").sortWithinPartitions("grp")))


def probe(index: Inverted, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(qid, rank, id, distance): the k nearest among the vectors of each query's nearest lists. Distances are exact; with product
    codes these choose REFINE * k rows of a tile whose exact distances decide."""
    lists = index.lists
    centre, books = lists.centroids, lists.books

    def ask(batches):
        for b in sliced(batches, 4096):
            near = nearest(matrix(b["vec"]), centre, min(probes, len(centre)))
            each = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            yield pa.record_batch([pa.array(near.reshape(-1)), b["qid"].take(each), b["vec"].take(each)], names=["grp", "qid", "vec"])

    def compare(q, b, group, best):
        x, ids = matrix(b["vec"]), b["id"].to_numpy()
        if books is None:
            closest(q, x, ids, best)
            return
        code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(ids), len(books))
        cut = np.split(q - centre[group], len(books), axis=1)
        closest(q, x, ids, best, lambda p: sum(squared(c[p], book)[:, code[:, i]] for i, (c, book) in enumerate(zip(cut, books))))

    asked = _queried(queries.where(F.size("vec") == centre.shape[1])).mapInArrow(ask, "grp long, qid long, vec array<double>")
    tiles = tiled(asked.hint("rebalance", "grp").sortWithinPartitions("grp"))
    found = best_pairs(tiles, index.tiles, k, np.float64, "qid long", lambda b, _: matrix(b["vec"]), compare)
    return _ranked(found, k, 1)  # a query has a list of each probe


def by_lists(base: DataFrame, queries: DataFrame, k: int, lists: Lists, probes: int) -> DataFrame:
    """An index of base, probed once."""
    return probe(inverted(base, lists), queries, k, probes)


def recall(found: DataFrame, true: DataFrame, k: int) -> DataFrame:
    """(hits, wanted, recall): distinct true ids that were found, of k for each query."""
    hits = found.select("qid", "id").distinct().join(true.select("qid", "id").distinct(), ["qid", "id"], "left_semi").agg(F.count("*").alias("hits"))
    wanted = true.agg((F.count_distinct("qid") * k).alias("wanted"))
    return hits.join(wanted).select("hits", "wanted", F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("hits") / F.col("wanted")).alias("recall"))


def code_bytes(base: DataFrame, index: Lists | None = None, bits: int = 0) -> DataFrame:
    """(index_bytes): what codes, ids and tables take: eight bytes an id, and bits, product codes or whole vectors a row."""
    tables = 0 if index is None else index.centroids.nbytes + sum(b.nbytes for b in index.books or [])
    each = bits // 8 if bits else len(index.books) if index is not None and index.books else None
    row = F.lit(each) if each is not None else 4 * F.size("vec")
    return base.agg((F.coalesce(F.sum(row + 8), F.lit(0)) + tables).cast("long").alias("index_bytes"))


def generated(spark, n: int, width: int, seed: int = 0) -> DataFrame:
    """(id, vec) of standard normal parts."""
    return spark.range(n).select("id", F.array(*[F.randn(seed + i) for i in range(width)]).alias("vec"))
