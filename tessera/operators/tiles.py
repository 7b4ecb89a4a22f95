"""Vectors as tiles (matrices of bounded size) in the shared folder, and top lists of pairs of tiles, merged as a tree.

Neither rows nor queries pass through the driver, nothing is broadcast, and the plan has one branch at any size: what is joined
are the tiles' names. A task reads one tile of queries, compares it with a run of tiles of rows and keeps the k best rows of
each query; the lists of all runs are merged BRANCH at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path, written
from ..sources.blocks import get_batch, one, put_batch, sliced

#: Components of a tile, entries of a product that are held at a time, tiles of rows in a run, lists of a merge.
TILE, HELD, RUN, BRANCH = 1 << 21, 1 << 22, 16, 16
#: Tasks that pairs of tiles are dealt to at most, and scores that make up a task.
TASKS, WORK = 1 << 16, 1 << 28


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n) if n else np.zeros((0, 0))


def tiled(rows: DataFrame, components: int | None = None) -> DataFrame:
    """(grp, name, start, n) of tiles: runs of rows (grp, vec, others) of one group, in files of about so many components.

    Rows of a group should be neighbours within partitions; a group's vectors have one width.
    """
    folder, limit = shared_path(rows.sparkSession, "tiles"), components or TILE

    def write(batches):
        def flush(held):
            batch = one(held)
            name = f"{folder}/{uuid.uuid4().hex}"
            put_batch(name, batch, None)
            group = batch.column("grp").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            n = np.diff(np.concatenate([first, [len(group)]]))
            return pa.record_batch([pa.array(group[first]), pa.array([name] * len(first)), pa.array(first), pa.array(n)], names=["grp", "name", "start", "n"])

        held, size = [], 0
        for b in sliced(batches, 4096):
            held.append(b)
            size += len(b.column("vec").flatten()) + b.num_rows
            if size >= limit:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return written(rows.mapInArrow(write, "grp long, name string, start long, n long"), "tiles_made")


class Best:
    """The k smallest (key, id) of each of n queries so far. worst is a query's k-th key, the largest there is while it has fewer."""

    def __init__(self, n: int, k: int, kind):
        self.n, self.k = n, k
        self.query, self.key, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        self.worst = np.full(n, np.inf if np.dtype(kind).kind == "f" else np.iinfo(kind).max, kind)

    def add(self, query: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in ((self.query, query), (self.key, key), (self.id, ids)))
        order = np.lexsort((i, s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep, last = place < self.k, place == self.k - 1
        self.worst[q[last]] = s[last]
        self.query, self.key, self.id = q[keep], s[keep], i[keep]


def parts(queries: int, rows: int) -> Iterator[slice]:
    """Slices of queries whose product with so many rows has at most HELD entries."""
    step = max(1, HELD // max(1, rows))
    return (slice(k, k + step) for k in range(0, queries, step))


class Tiles:
    """Reads tiles; the last files stay."""

    def __init__(self):
        self.held: dict[str, pa.RecordBatch] = {}

    def __call__(self, name: str, start: int, n: int) -> pa.RecordBatch:
        if name not in self.held:
            while len(self.held) > 2:
                del self.held[next(iter(self.held))]
            self.held[name] = get_batch(name)
        return self.held[name].slice(start, n)


def best_pairs(queries: DataFrame, rows: DataFrame, k: int, kind, schema: str, prepare: Callable, compare: Callable) -> DataFrame:
    """(the columns of schema, id, score) for each query: its k smallest scores among the rows of its group, ties to the smaller id.

    queries and rows are tables of tiles. prepare(batch, group) makes what compare needs of a tile of queries;
    compare(prepared, batch, group, best) puts a tile of rows into best. schema names the columns of queries that pass, kind is
    the type of scores (np.float64 or np.int64). Lists come out unmerged, with the number of their run.
    """
    spark = queries.sparkSession
    number = F.row_number().over(Window.partitionBy("grp").orderBy("name", "start")) - 1  # tiles, not rows
    n, workers = queries.count(), spark.sparkContext.defaultParallelism
    right = rows.count()
    run = max(1, min(RUN, -(-n * right // (2 * workers))))  # fewer tiles a run while there are too few runs for all workers
    numbered = rows.select("grp", F.struct("name", "start", "n").alias("tile"), F.floor(number / run).alias("run"))
    runs = numbered.groupBy("grp", "run").agg(F.sort_array(F.collect_list("tile")).alias("right"))
    held = queries.select("grp", F.struct("name", "start", "n").alias("left"))
    names = [c.split()[0] for c in schema.split(", ")]
    score = pa.float64() if np.dtype(kind).kind == "f" else pa.int64()

    def search(batches):
        tile = Tiles()
        for b in batches:
            for group, run, left, right in zip(*(b.column(j).to_pylist() for j in range(4))):
                mine = tile(**left)
                ready, best = prepare(mine, group), Best(mine.num_rows, k, kind)
                for r in right:
                    compare(ready, tile(**r), group, best)
                for j in range(0, len(best.query), 10_000):
                    q = pa.array(best.query[j : j + 10_000])
                    kept = [mine.column(c).take(q) for c in names]
                    yield pa.record_batch([*kept, pa.array(best.id[j : j + 10_000]), pa.array(best.key[j : j + 10_000], score), pa.array(np.full(len(q), run))], names=[*names, "id", "score", "run"])

    pairs = written(held.join(runs, "grp").select("grp", "run", "left", "right"), "pairs")
    about = pairs.agg(F.count("*").alias("n"), F.sum(F.col("left.n") * F.aggregate("right", F.lit(0).cast("long"), lambda a, t: a + t["n"])).alias("work")).first()
    dealt = pairs.repartition(max(1, min(about["n"], max(2 * workers, (about["work"] or 0) // WORK), TASKS)))
    return dealt.mapInArrow(search, f"{schema}, id long, score {'double' if score == pa.float64() else 'long'}, run long")


def merged(found: DataFrame, by: list[str], k: int, runs: int) -> DataFrame:
    """found with rank (from 1), the k smallest (score, id) of each query: lists of up to BRANCH runs at a time, level by level."""
    order = ("score", "id")
    while runs > BRANCH:
        found = found.withColumn("run", F.floor(F.col("run") / BRANCH))
        rank = F.row_number().over(Window.partitionBy(*by, "run").orderBy(*order))
        found = found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
        runs = -(-runs // BRANCH)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("run")


def most_tiles(tiles: DataFrame) -> int:
    """Tiles of the largest group."""
    return tiles.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
