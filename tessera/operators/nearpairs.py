"""Pairs of 3-D points closer than a threshold: exact over a grid, approximate over hash tables of random projections, naive."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Projections that make up one table's key, and a cell's width in thresholds.
PROJECTIONS, WIDTHS = 3, 3.0
#: Comparisons of a row that take as long as sorting it in for a column, and pairs of rows that are compared at a time.
EACH, PRODUCTS = 512, 1 << 18
#: Classes of a cell up to which it is compared together with others.
TOGETHER = 64


@dataclass(frozen=True)
class Tables:
    """Directions [table][projection][axis], offsets [table][projection] and the cells' width."""

    directions: list
    offsets: list
    width: float

    @classmethod
    def drawn(cls, tables: int, threshold: float, seed: int = 11) -> Tables:
        if tables <= 0 or not threshold > 0:
            raise ValueError("tables and threshold must be positive")
        rng = np.random.default_rng(seed)
        d = rng.normal(size=(tables, PROJECTIONS, 3))
        d /= np.linalg.norm(d, axis=2, keepdims=True)
        width = WIDTHS * threshold
        return cls(d.tolist(), rng.uniform(0, width, (tables, PROJECTIONS)).tolist(), width)


def squared_distance(a: str, b: str) -> Column:
    return sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "xyz")


def naive_pairs(points: DataFrame, threshold: float) -> DataFrame:
    """All pairs (lo, hi) by comparison of every pair: the definition, for tests and as a baseline on small tables."""
    a, b = points.alias("a"), points.alias("b")
    return a.join(b, (F.col("a.pos") < F.col("b.pos")) & (squared_distance("a", "b") < threshold * threshold)).select(F.col("a.pos").alias("lo"), F.col("b.pos").alias("hi"))


def grid_pairs(points: DataFrame, threshold: float) -> DataFrame:
    """The same pairs by an equi-join: cells as wide as the threshold, one side in its own cell, the other in its own and the 13
    that follow it among the 26 around, so that each pair of cells meets once."""
    if not threshold > 0:
        raise ValueError("the threshold must be positive")
    at = [F.floor(F.col(c) / threshold).alias(f"c{c}") for c in "xyz"]
    own = points.select("pos", "x", "y", "z", *at)
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    shift = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("xyz", step)], F.lit(step == (0, 0, 0)).alias("home")) for step in steps])
    near = own.select("pos", "x", "y", "z", "cx", "cy", "cz", F.explode(shift).alias("s")).select("pos", "x", "y", "z", "s.home", *[(F.col(f"c{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in "xyz"])
    a, b = own.alias("a"), near.alias("b")
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.cz") == F.col("b.cz"))
    once = ~F.col("b.home") | (F.col("a.pos") < F.col("b.pos"))
    pairs = a.join(b, same & once & (squared_distance("a", "b") < threshold * threshold))
    return pairs.select(F.least("a.pos", "b.pos").alias("lo"), F.greatest("a.pos", "b.pos").alias("hi"))


def cells(points: DataFrame, tables: Tables) -> DataFrame:
    """A row for each point and table: (pos, x, y, z, t, c0, c1, c2)."""

    def key(t: int) -> Column:
        parts = [F.floor((F.col("x") * d[0] + F.col("y") * d[1] + F.col("z") * d[2] + o) / tables.width).alias(f"c{j}") for j, (d, o) in enumerate(zip(tables.directions[t], tables.offsets[t]))]
        return F.struct(F.lit(t).alias("t"), *parts)

    keys = F.array(*[key(t) for t in range(len(tables.directions))])
    return points.select("pos", "x", "y", "z", F.explode(keys).alias("k")).select("pos", "x", "y", "z", "k.t", "k.c0", "k.c1", "k.c2")


def _shared(a: DataFrame, b: DataFrame, tables: Tables, *tests: Column) -> DataFrame:
    """Pairs (a, b) of rows of cells that share a cell and pass the tests, each pair from the first table whose cell both share:
    pairs come out once, without a shuffle to make them distinct. Earlier tables are a loop over a constant, not code for each."""
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.c0") == F.col("b.c0")) & (F.col("a.c1") == F.col("b.c1")) & (F.col("a.c2") == F.col("b.c2"))
    for test in tests:
        same = same & test
    drawn = F.array(*[F.struct(*[F.array(*[F.lit(v) for v in (*d, o)]).alias(f"p{j}") for j, (d, o) in enumerate(zip(ds, os))]) for ds, os in zip(tables.directions, tables.offsets)])

    def cell(point: str, p: Column) -> Column:
        return F.floor((F.col(f"{point}.x") * p[0] + F.col(f"{point}.y") * p[1] + F.col(f"{point}.z") * p[2] + p[3]) / tables.width)

    def together(table: Column) -> Column:
        first, *others = (cell("a", table[f"p{j}"]) == cell("b", table[f"p{j}"]) for j in range(PROJECTIONS))
        for c in others:
            first = first & c
        return first

    return a.join(b, same & ~F.exists(F.slice(drawn, F.lit(1), F.col("a.t")), together))


def candidates(points: DataFrame, tables: Tables) -> DataFrame:
    """Distinct pairs that share a cell of some table, with their squared distance."""
    c = cells(points, tables)
    pairs = _shared(c.alias("a"), c.alias("b"), tables, F.col("a.pos") < F.col("b.pos"))
    return pairs.select(F.col("a.pos").alias("lo"), F.col("b.pos").alias("hi"), squared_distance("a", "b").alias("d2"))


def hashed_pairs(points: DataFrame, tables: Tables, threshold: float) -> DataFrame:
    """Candidates closer than the threshold. One shuffle by cell; adaptive execution splits a hot cell's join."""
    c = cells(points, tables)
    near = _shared(c.alias("a"), c.alias("b"), tables, F.col("a.pos") < F.col("b.pos"), squared_distance("a", "b") < threshold * threshold)
    return near.select(F.col("a.pos").alias("lo"), F.col("b.pos").alias("hi"))


@dataclass(frozen=True)
class Stored:
    """An index of near pairs that grows: the cells of all points so far, a folder of them for each batch added."""

    path: str
    tables: Tables
    threshold: float


def stored(spark: SparkSession, tables: Tables, threshold: float, path: str | None = None) -> Stored:
    return Stored(path or shared_path(spark, "cells"), tables, threshold)


def add(index: Stored, points: DataFrame, batch: int) -> DataFrame:
    """Adds a batch of points, numbered from 0, and returns the pairs (lo, hi) that it makes: among themselves and with all earlier
    ones. Only the batch is hashed; batches before it are read as they were written. Adding a batch again replaces it."""
    spark, limit = points.sparkSession, index.threshold * index.threshold
    cells(points, index.tables).write.mode("overwrite").parquet(f"{index.path}/batch={batch}")
    new = spark.read.parquet(f"{index.path}/batch={batch}")
    close = squared_distance("a", "b") < limit
    named = [F.least("a.pos", "b.pos").alias("lo"), F.greatest("a.pos", "b.pos").alias("hi")]
    pairs = _shared(new.alias("a"), new.alias("b"), index.tables, F.col("a.pos") < F.col("b.pos"), close).select(*named)
    if not batch:
        return pairs
    old = spark.read.parquet(*[f"{index.path}/batch={k}" for k in range(batch)])
    return pairs.union(_shared(old.alias("a"), new.alias("b"), index.tables, close).select(*named))


def candidate_stats(points: DataFrame, tables: Tables) -> DataFrame:
    """(total_candidates, unique_candidates): pairs over all cells, and distinct ones, as many as candidates() has rows; both are
    counted in one pass, without a row for each.

    Points with the same cells in all tables are one class, with their number: there are as many classes as the tables' planes cut
    space into, however many points there are. Pairs of classes are counted in the first table whose cell both share. Points
    without coordinates are a cell of their own in each table, as SQL groups them, whose pairs are not candidates."""
    cell = [F.floor((F.col("x") * d[0] + F.col("y") * d[1] + F.col("z") * d[2] + o) / tables.width) for ds, os in zip(tables.directions, tables.offsets) for d, o in zip(ds, os)]
    classes = points.select(F.array(*cell).alias("cells")).groupBy("cells").agg(F.count("*").alias("n"))
    t, key = F.col("t"), ["t", *[f"c{k}" for k in range(PROJECTIONS)]]
    own = [F.element_at("cells", PROJECTIONS * t + k + 1).alias(f"c{k}") for k in range(PROJECTIONS)]
    each = classes.select("cells", "n", F.explode(F.sequence(F.lit(0), F.lit(len(tables.directions) - 1))).alias("t")).select("t", *own, F.slice("cells", F.lit(1), PROJECTIONS * t).alias("earlier"), "n")

    def count(batches):
        for cut, rows in _whole(batches, key):
            total, unique = _counted(cut, rows)
            yield pa.record_batch({"total": pa.array([total], pa.int64()), "uniq": pa.array([unique], pa.int64())})

    counts = each.repartition(*key).sortWithinPartitions(*key).mapInArrow(count, "total long, uniq long")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{name}_candidates") for c, name in (("total", "total"), ("uniq", "unique"))])


def unique_candidates(points: DataFrame, tables: Tables) -> DataFrame:
    """(unique_candidates): as many rows as candidates() has, counted without a row for each."""
    return candidate_stats(points, tables).select("unique_candidates")


def _whole(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by key as tables that hold all rows of each of their keys, and where their keys begin."""
    held, cuts, rows, last = [], [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [v for c in key for v in (batch.column(c).is_valid().to_numpy(zero_copy_only=False), batch.column(c).fill_null(0).to_numpy())]
        at = np.flatnonzero(np.any([np.diff(v, prepend=v[:1]) != 0 for v in columns], axis=0))
        if last != [v[0] for v in columns]:
            at = np.append(0, at)
        last = [v[-1] for v in columns]
        if len(at) and rows + at[-1]:
            end = int(at[-1])
            yield np.concatenate([*cuts, at[:-1] + rows]), pa.Table.from_batches([*held, batch.slice(0, end)]).combine_chunks()
            held, cuts, rows, at, batch = [], [], 0, np.zeros(1, np.int64), batch.slice(end)
        held.append(batch)
        cuts.append(at + rows)
        rows += batch.num_rows
    if held:
        yield np.concatenate(cuts), pa.Table.from_batches(held).combine_chunks()


def _counted(starts: np.ndarray, rows: pa.Table) -> tuple[int, int]:
    """Pairs of points in the cells that begin at starts, and those of them that share no cell of an earlier table. Cells of few
    classes are compared together, step by step along the rows."""
    n, edges = rows.column("n").to_numpy(), np.append(starts, rows.num_rows)
    table, known, sizes = rows.column("t").to_numpy()[starts], rows.column("c0").is_valid().to_numpy()[starts], np.diff(edges)
    points = np.add.reduceat(n, starts)
    pairs = points * (points - 1) // 2
    total, unique = int(pairs.sum()), int(pairs[known & (table == 0)].sum())
    for t in np.unique(table[(table > 0) & (sizes > 1)]):
        of = np.flatnonzero(table == t)
        first, end, size = edges[of[0]], edges[of[-1] + 1], sizes[of]
        cells = rows.column("earlier").slice(first, end - first).combine_chunks().flatten().fill_null(0).to_numpy().reshape(-1, t, PROJECTIONS)
        some = n[first:end]
        for start, many in zip(starts[of] - first, size):
            if many > TOGETHER:
                mine = slice(start, start + many)
                unique += _apart([_numbers(cells[mine, k]) for k in range(t)], some[mine])
        left = np.repeat(np.cumsum(size), size) - np.arange(len(some)) - 1  # rows of the cell that follow
        few = np.repeat((size > 1) & (size <= TOGETHER), size)
        if not few.any():
            continue
        codes, some, left = [_codes(cells[few, k]) for k in range(t)], some[few], left[few]
        for step in range(1, int(left.max()) + 1):
            a = np.flatnonzero(left >= step)
            far = np.ones(len(a), bool)
            for c in codes:
                far &= c[a] != c[a + step]
            unique += int((some[a] * some[a + step])[far].sum())
    return total, unique


def _codes(cells: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows only."""
    out, room = np.zeros(len(cells), np.int64), 1
    for column in cells.T:
        least, most = int(column.min()), int(column.max())
        if room * (most - least + 1) >= 1 << 62:  # numbered closely, they have room
            out, column = (np.unique(v, return_inverse=True)[1] for v in (out, column))
            room, least, most = len(out), 0, len(out) - 1
        out, room = out * (most - least + 1) + (column - least), room * (most - least + 1)
    return out


def _numbers(cells: np.ndarray) -> np.ndarray:
    """The same from 0 on, without gaps."""
    out = np.unique(_codes(cells), return_inverse=True)[1]
    return out.astype(np.int16 if len(out) < 1 << 15 else np.int32)


def _apart(cells: list[np.ndarray], n: np.ndarray) -> int:
    """Pairs of rows, times both their numbers n, that share none of the cells. Of many rows, those that share no cell of all columns
    but one, less those of them that share that one: linear in rows, but for each column twice as much; of few, each pair."""
    rows = len(n)
    if rows < 2:
        return 0
    if not cells:
        return (int(n.sum()) ** 2 - int((n * n).sum())) // 2
    if rows * len(cells) <= EACH << len(cells):
        return _compared(cells, n)
    *rest, last = cells
    order = np.argsort(last, kind="stable")
    cuts = np.flatnonzero(np.diff(last[order], prepend=-1, append=-1))
    pairs = _apart(rest, n)
    for at in (order[i:j] for i, j in zip(cuts[:-1], cuts[1:]) if j - i > 1):
        pairs -= _apart([c[at] for c in rest], n[at])
    return pairs


def _compared(cells: list[np.ndarray], n: np.ndarray) -> int:
    """The same by comparison of every pair."""
    rows, total, start = len(n), 0, 0
    single, small = bool((n == 1).all()), int(n.sum()) ** 2 < 1 << 53
    weight = n.astype(np.float64) if small else n
    while start < rows:
        end = min(rows, start + max(1, PRODUCTS // (rows - start)))
        far = np.ones((end - start, rows - start), bool)
        for c in cells:
            far &= c[start:end, None] != c[None, start:]
        own = end - start  # pairs among these rows stand there twice
        if single:
            total += int(np.count_nonzero(far)) - int(np.count_nonzero(far[:, :own])) // 2
        else:
            far = far.astype(weight.dtype)
            total += int(weight[start:end] @ (far @ weight[start:])) - int(weight[start:end] @ (far[:, :own] @ weight[start:end])) // 2
        start = end
    return total


def quality(found: DataFrame, true: DataFrame) -> DataFrame:
    """(found, true, hits, recall, precision); an empty side counts as 1."""
    hits = found.join(true, ["lo", "hi"], "left_semi").agg(F.count("*").alias("hits"))
    out = found.agg(F.count("*").alias("found")).join(true.agg(F.count("*").alias("true"))).join(hits)
    share = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.col("hits") / F.col(n))
    return out.select("found", "true", "hits", share("true").alias("recall"), share("found").alias("precision"))


def candidate_ratio(points: DataFrame, tables: Tables) -> DataFrame:
    """(unique_candidates, all_pairs, candidate_ratio): distinct candidates among all pairs; 0 for fewer than two points."""
    n = points.agg(F.expr("count(*) * (count(*) - 1) div 2").alias("all_pairs"))
    both = unique_candidates(points, tables).join(n)
    return both.withColumn("candidate_ratio", F.when(F.col("all_pairs") == 0, 0.0).otherwise(F.col("unique_candidates") / F.col("all_pairs")))


def metrics(spark: SparkSession, n: int, threshold: float, seeds: list[int], tables: int = 10) -> DataFrame:
    """Means and sample deviations over seeds of generated points: true pairs, candidates and their share of all pairs, recall,
    precision, milliseconds of the naive and the hashed search, and how much faster the latter is."""
    rows = []

    def timed(df: DataFrame) -> float:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return (time.perf_counter() - began) * 1000

    for seed in seeds:
        points, drawn = generated(spark, n, threshold, seed).cache(), Tables.drawn(tables, threshold, seed + 1000)
        points.count()
        naive, hashed = naive_pairs(points, threshold), hashed_pairs(points, drawn, threshold)
        slow, fast = timed(naive), timed(hashed)
        q, c = quality(hashed, naive).first(), candidate_ratio(points, drawn).first()
        points.unpersist()
        rows.append((n, float(q["true"]), float(c["unique_candidates"]), c["candidate_ratio"], q["recall"], q["precision"], fast, slow, slow / fast))
    names = ["true_pairs", "candidates", "candidate_ratio", "recall", "precision", "find_ms", "naive_ms", "speedup"]
    each = spark.createDataFrame(rows, "n long, " + ", ".join(f"{c} double" for c in names))
    deviation = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")
    return each.groupBy("n").agg(F.count("*").alias("seeds"), *[f for c in names for f in (F.avg(c).alias(f"{c}_mean"), deviation(c))])


def generated(spark: SparkSession, n: int, threshold: float, seed: int = 11, copies: float = 0.12) -> DataFrame:
    """(pos, x, y, z): a jittered lattice 4.5 thresholds wide, and copies at 0.18 to 0.30 thresholds of points of their own."""
    if n <= 0:
        return spark.createDataFrame([], "pos long, x double, y double, z double")
    extra = int(n * copies)
    base = n - extra
    side = max(1, int(np.ceil(round(base ** (1 / 3), 9))))
    rows = spark.range(base).withColumnRenamed("id", "pos")
    at = [F.floor(F.col("pos") / side**k) % side for k in range(3)]
    jitter = lambda k: (F.rand(seed + k) - 0.5) * 0.16 * threshold
    lattice = rows.select("pos", *[(a * 4.5 * threshold + jitter(k)).alias(c) for k, (a, c) in enumerate(zip(at, "xyz"))])
    if not extra:
        return lattice
    u, v, r = F.rand(seed + 7) * 2 - 1, F.rand(seed + 8) * 2 * np.pi, (0.18 + 0.12 * F.rand(seed + 9)) * threshold
    moved = lattice.where(F.col("pos") < extra).withColumns({"u": u, "v": v, "r": r})
    flat = F.sqrt(1 - F.col("u") * F.col("u")) * F.col("r")
    dup = moved.select((F.col("pos") + base).alias("pos"), (F.col("x") + flat * F.cos("v")).alias("x"), (F.col("y") + flat * F.sin("v")).alias("y"), (F.col("z") + F.col("u") * F.col("r")).alias("z"))
    return lattice.union(dup)
