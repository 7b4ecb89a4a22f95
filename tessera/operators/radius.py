"""All points within a radius of each centre: naive, over covering cells, over bands of latitude with bounding windows, and over the
leaves of a tree of median splits."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sphere import cell, chord_term, clamp_lat, half_height, half_width, haversine_term, largest_term, normal_lng, unit
from ..session import shared_path, written
from .tiles import TASKS, Tiles, matrix, tiled

#: Terms of haversines and of chords differ by less than this: at most 1e-14, by rounding.
HAIR = 1e-12
#: The same where chords are products of vectors in single precision, which are off by 4e-7 at most.
SINGLE = 1e-6
#: Components of a tile that is compared with another, products that a core's cache holds, pairs of a batch.
COMPARED, CACHED, HELD = 1 << 15, 1 << 18, 1 << 18
#: Points of a cell, band or leaf beyond which it is dealt out in pieces.
CROWD = 16384
#: Degrees of longitude in a piece of a band.
PIECE = 30.0


def normal(points: DataFrame) -> DataFrame:
    """Points or centres with latitude clamped and longitude in [-180, 180); rows with a null or non-finite part go."""
    known = points.where(F.col("lat").isNotNull() & ~F.isnan("lat") & F.col("lng").isNotNull())
    return known.withColumns({"lat": clamp_lat(F.col("lat")), "lng": normal_lng(F.col("lng"))}).where(F.col("lng").isNotNull())


def _centred(centres: DataFrame) -> DataFrame:
    """Centres in normal form, with the largest term that their radius holds. They are dealt out, as a small file is one task's."""
    q = normal(centres).select("qid", "lat", "lng", "radius_m").withColumn("most", largest_term(F.col("radius_m"))).where("most >= 0")
    return q.repartition(q.sparkSession.sparkContext.defaultParallelism)


def _inside():
    """The haversine's term within the radius's. The chord's decides but for a hair: that has no sines for each pair."""
    chord, most = chord_term("q", "p"), F.col("q.most")
    exact = haversine_term(F.col("q.lat"), F.col("q.lng"), F.col("p.lat"), F.col("p.lng")) <= most
    return (chord <= most + HAIR) & ((chord <= most - HAIR) | exact)


def _joined(points: DataFrame, centres: DataFrame, keys: list[str], *tests: Column) -> DataFrame:
    """(qid, id) within the radius of rows (id, lat, lng, keys) and (qid, lat, lng, most, keys) that share the keys and pass the tests.
    Both sides are shuffled, whatever their size: what is small as a file is many rows in its cells and more pairs, which one task
    or one broadcast must not take. Points of keys with over CROWD of them are dealt out in pieces, each of which meets all centres."""
    pieces = points.groupBy(*keys).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("pieces"))
    points = points.join(pieces, keys).withColumn("piece", F.pmod(F.xxhash64("id", "lat", "lng"), F.col("pieces")).cast("int")).drop("pieces")
    centres = centres.join(pieces, keys).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    p, q = unit(points).alias("p"), unit(centres).alias("q")
    on = _inside()
    for test in reversed(tests):
        on = test & on
    for key in ("piece", *reversed(keys)):
        on = (F.col(f"q.{key}") == F.col(f"p.{key}")) & on
    return q.join(p.hint("merge"), on).select("q.qid", "p.id")


def naive(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(qid, id) by comparison of every centre with every point: the definition, for tests and as a baseline. Tasks compare tiles of
    both by their chords; pairs within a hair of the radius carry their coordinates on, for the haversine to decide."""
    p, q = normal(points).select("id", "lat", "lng"), _centred(centres).drop("radius_m")
    some, all_ = (tiled(unit(side).select(F.lit(0).cast("long").alias("grp"), F.array("x", "y", "z").alias("vec"), *side.columns), COMPARED) for side in (q, p))
    tile = F.struct("name", "start", "n")
    pairs = written(some.select(tile.alias("q")).crossJoin(all_.select(tile.alias("p"))), "pairs")

    def compare(batches):
        read = Tiles()
        for b in batches:
            for one, other in zip(b.column("q").to_pylist(), b.column("p").to_pylist()):
                yield from _compared(read(**one), read(**other))

    kinds = q.schema["qid"].dataType.simpleString(), p.schema["id"].dataType.simpleString()
    n, workers = pairs.count(), q.sparkSession.sparkContext.defaultParallelism
    dealt = pairs.repartition(max(1, min(n, max(4 * workers, n // 16), TASKS)))
    near = dealt.mapInArrow(compare, f"qid {kinds[0]}, id {kinds[1]}, edge array<double>")
    e = [F.element_at("edge", k) for k in range(1, 6)]
    return near.where(F.col("edge").isNull() | (haversine_term(e[0], e[1], e[2], e[3]) <= e[4])).select("qid", "id")


def _compared(centres: pa.RecordBatch, points: pa.RecordBatch):
    """Batches (qid, id, edge) of the pairs whose term is within the radius's, or may be: these have an edge, (lat, lng, lat, lng, most)."""
    u, v = matrix(centres.column("vec")).astype(np.float32), matrix(points.column("vec")).astype(np.float32).T.copy()
    most = centres.column("most").to_numpy()
    # Of unit vectors the chord's term is (1 - product) / 2.
    least, sure = ((1 - 2 * (most + by)).astype(np.float32) for by in (SINGLE, -SINGLE))
    wide, held, size = v.shape[1], [], 0
    step = max(1, CACHED // wide)
    for start in range(0, len(u), step):
        product = u[start : start + step] @ v
        at = np.flatnonzero(product >= least[start : start + step, None])
        row = (at // wide).astype(np.int32)
        held.append((row + np.int32(start), (at - row * np.int64(wide)).astype(np.int32), product.ravel()[at]))
        size += len(at)
        if size >= HELD or start + step >= len(u):
            row, column, product = map(np.concatenate, zip(*held))
            held, size = [], 0
            edge = product <= sure[row]
            r, c = row[edge], column[edge]
            told = [centres.column(k).to_numpy()[r] for k in ("lat", "lng")] + [points.column(k).to_numpy()[c] for k in ("lat", "lng")] + [most[r]]
            ends = pa.array(np.concatenate([[0], np.cumsum(5 * edge)]), pa.int32())
            edges = pa.ListArray.from_arrays(ends, pa.array(np.stack(told, axis=1).ravel(), pa.float64()), mask=pa.array(~edge))
            yield pa.record_batch([centres.column("qid").take(pa.array(row)), points.column("id").take(pa.array(column)), edges], names=["qid", "id", "edge"])


def _round(degrees: float) -> tuple[int, float]:
    """Cells round the circle, and their width."""
    if not degrees > 0:
        raise ValueError("cells must have a positive width")
    n = max(1, int(360 / degrees))
    return n, 360.0 / n


def celled(points: DataFrame, degrees: float, pieces: float | None = None) -> DataFrame:
    """Points (id, lat, lng) in normal form with their cell (cy, cx), of degrees of latitude and of pieces of longitude if given."""
    round_, wide = _round(pieces or degrees)
    return normal(points).select("id", "lat", "lng").withColumns({"cy": cell(F.col("lat"), degrees), "cx": F.pmod(cell(F.col("lng") + 180.0, wide), F.lit(round_))})


def over_cells(points: DataFrame, centres: DataFrame, degrees: float = 5.0) -> DataFrame:
    """The same by an equi-join on cells: a centre stands in every cell that its window touches, once each. Longitude is cut
    into equal cells of at least degrees, counted round the circle."""
    return _met(celled(points, degrees), centres, degrees)


def _standing(centres: DataFrame, degrees: float, pieces: float) -> DataFrame:
    """Centres in every cell of degrees of latitude and pieces of longitude that their window (h, w) touches, once each."""
    round_, wide = _round(pieces)
    q = _centred(centres)
    h, w = half_height(F.col("radius_m")), half_width(F.col("lat"), F.col("radius_m"))
    rows = F.sequence(cell(F.greatest(F.col("lat") - h, F.lit(-90.0)), degrees), cell(F.least(F.col("lat") + h, F.lit(90.0)), degrees))
    span = F.sequence(cell(F.col("lng") + 180.0 - w, wide), cell(F.col("lng") + 180.0 + w, wide))
    columns = F.when(w >= 180.0, F.sequence(F.lit(0).cast("long"), F.lit(round_ - 1).cast("long"))).otherwise(F.array_distinct(F.transform(span, lambda x: F.pmod(x, F.lit(round_)))))
    return q.withColumns({"h": h, "w": w}).withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(columns)).drop("radius_m")


def _met(cells: DataFrame, centres: DataFrame, degrees: float) -> DataFrame:
    return _joined(cells, _standing(centres, degrees, degrees).drop("h", "w"), ["cy", "cx"])


@dataclass(frozen=True)
class Stored:
    """A grid that grows: the cells of all points so far, a folder for each batch added."""

    path: str
    degrees: float


def stored(spark: SparkSession, degrees: float = 5.0, path: str | None = None) -> Stored:
    _round(degrees)
    return Stored(path or shared_path(spark, "grid"), degrees)


def add(grid: Stored, points: DataFrame, batch: int) -> None:
    """Adds a batch of points, numbered by the caller; adding a batch again replaces it."""
    celled(points, grid.degrees).write.mode("overwrite").parquet(f"{grid.path}/batch={batch}")


def find(grid: Stored, centres: DataFrame) -> DataFrame:
    """(qid, id) of all points added so far; their cells are read as they were written."""
    return _met(centres.sparkSession.read.schema("id long, lat double, lng double, cy long, cx long").parquet(grid.path), centres, grid.degrees)


def splits(points: DataFrame, depth: int, sample: int = 20_000) -> tuple[list[float], dict[int, tuple]]:
    """A tree of median splits, latitude and longitude by turns: the values that the nodes split at, level by level, and the box of
    each leaf that points can reach: least and most latitude, least and most longitude. Medians are those of a bounded sample, the
    points of the smallest hash of their id: where a tree is cut decides only how even its leaves are."""
    rows = np.array([(r["lat"], r["lng"]) for r in points.select("id", "lat", "lng").orderBy(F.xxhash64("id"), "id").limit(sample).collect()]).reshape(-1, 2)
    values, held = [360.0] * (2**depth - 1), {0: (rows, (-90.0, 90.0, -180.0, 180.0))}
    for level in range(depth):
        axis, below = level % 2, {}
        for node, (some, box) in held.items():
            if len(some) < 2:
                below[2 * node + 1] = some, box  # all of it goes below
                continue
            at = float(np.partition(some[:, axis], len(some) // 2)[len(some) // 2])
            values[node], inside = at, some[:, axis] < at
            low, high = list(box), list(box)
            low[2 * axis + 1] = high[2 * axis] = at
            below[2 * node + 1], below[2 * node + 2] = (some[inside], tuple(low)), (some[~inside], tuple(high))
        held = below
    return values, {node: box for node, (_, box) in held.items()}


def leaved(points: DataFrame, values: list[float], depth: int) -> DataFrame:
    """Points (id, lat, lng) in normal form with their leaf of a tree that splits at values."""
    # Constants of one literal each: an expression for each node would keep the planner busy.
    nodes = F.from_json(F.lit(json.dumps(values)), "array<double>")

    def down(node: Column, level: Column) -> Column:
        own = F.when(level % 2 == 0, F.col("lat")).otherwise(F.col("lng"))
        return 2 * node + F.when(own < F.element_at(nodes, node + 1), 1).otherwise(2)

    levels = F.array(*[F.lit(k) for k in range(depth)]) if depth else F.array().cast("array<int>")
    return normal(points).select("id", "lat", "lng").withColumn("leaf", F.aggregate(levels, F.lit(0), down))


def over_tree(points: DataFrame, centres: DataFrame, depth: int = 6) -> DataFrame:
    """The same by an equi-join on the leaves of a tree of median splits: a point has one leaf, a centre those whose box its window
    touches. The tree has at most 2**depth leaves, whatever the number of points."""
    values, boxes = splits(normal(points), depth)
    return _touched(leaved(points, values, depth), centres, boxes)


@dataclass(frozen=True)
class Planted:
    """A tree that points are added to: its splits, those of the first batch, and the leaves of all points so far, by batch."""

    path: str
    depth: int
    values: list
    boxes: dict


def planted(points: DataFrame, depth: int = 6, path: str | None = None) -> Planted:
    """A tree split by these points, which are its batch 0. Later points go to its leaves, however they lie: that decides only how
    even the leaves are, as a tree that is added to is rebuilt from time to time."""
    tree = Planted(path or shared_path(points.sparkSession, "tree"), depth, *splits(normal(points), depth))
    plant(tree, points, 0)
    return tree


def plant(tree: Planted, points: DataFrame, batch: int) -> None:
    """Adds a batch of points, numbered by the caller; adding a batch again replaces it."""
    leaved(points, tree.values, tree.depth).write.mode("overwrite").parquet(f"{tree.path}/batch={batch}")


def found(tree: Planted, centres: DataFrame) -> DataFrame:
    """(qid, id) of all points of the tree so far; their leaves are read as they were written."""
    leaves = centres.sparkSession.read.schema("id long, lat double, lng double, leaf int").parquet(tree.path)
    return _touched(leaves, centres, tree.boxes)


def _touched(leaves: DataFrame, centres: DataFrame, boxes: dict[int, tuple]) -> DataFrame:
    q = _centred(centres)
    h, w = half_height(F.col("radius_m")), half_width(F.col("lat"), F.col("radius_m"))
    named = [dict(zip(("leaf", "s", "n", "w", "e"), (leaf, *box))) for leaf, box in boxes.items()]
    every = F.from_json(F.lit(json.dumps(named)), "array<struct<leaf: int, s: double, n: double, w: double, e: double>>")
    q = q.withColumns({"h": h, "half": w})

    def touched(b: Column) -> Column:
        reach = F.lit(False)
        for turn in (-360.0, 0.0, 360.0):  # windows over the date line meet boxes a turn away
            reach = reach | ((F.col("lng") - F.col("half") + turn <= b["e"]) & (F.col("lng") + F.col("half") + turn >= b["w"]))
        return (F.col("lat") - F.col("h") <= b["n"]) & (F.col("lat") + F.col("h") >= b["s"]) & reach

    q = q.withColumn("leaf", F.explode(F.transform(F.filter(every, touched), lambda b: b["leaf"]))).drop("radius_m", "h", "half")
    return _joined(leaves, q, ["leaf"])


def over_bands(points: DataFrame, centres: DataFrame, degrees: float = 5.0) -> DataFrame:
    """The same by an equi-join on bands of latitude, in pieces of PIECE degrees of longitude so that a band is not one task's, with the
    bounding window tested before the distance."""
    apart = F.abs(F.col("p.lng") - F.col("q.lng"))
    beside = (apart <= F.col("q.w")) | (360.0 - apart <= F.col("q.w"))
    window = beside & F.col("p.lat").between(F.col("q.lat") - F.col("q.h"), F.col("q.lat") + F.col("q.h"))
    return _joined(celled(points, degrees, PIECE), _standing(centres, degrees, PIECE), ["cy", "cx"], window)


STRATEGIES = {"naive": naive, "cells": over_cells, "bands": over_bands, "tree": over_tree}


def search(points: DataFrame, centres: DataFrame, strategy: str = "cells", **options) -> DataFrame:
    """(qid, id) by one of STRATEGIES; all give the same rows."""
    return STRATEGIES[strategy](points, centres, **options)


def kth(points: DataFrame, column: str, k: int) -> DataFrame:
    """The row of the k-th smallest value (from 0), ties by id: a pruning split point. Quantile sketches bound the range first, so
    that only rows around the place are sorted."""
    n = points.where(F.col(column).isNotNull()).count()
    if not 0 <= k < n:
        return points.limit(0)
    slack, error = 0.02, 0.005
    low, high = points.approxQuantile(column, [max(0.0, k / n - slack), min(1.0, (k + 1) / n + slack)], error)
    below = points.where(F.col(column) < low).count()
    near = points.where(F.col(column).between(low, high))
    if below > k or below + near.count() <= k:  # the sketch was off: take all
        below, near = 0, points.where(F.col(column).isNotNull())
    return near.orderBy(column, "id").offset(k - below).limit(1)
