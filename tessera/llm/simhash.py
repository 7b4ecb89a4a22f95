"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, sliced, utf8, written

SEED = 42
#: Hashes whose bits are counted at a time: bounds memory for very long texts.
CHUNK = 1 << 15
#: Bits of a fingerprint are dealt into RADIUS + 2 blocks; of any two fingerprints within RADIUS at least two blocks are equal.
BLOCKS_KEPT = 2
#: Distinct fingerprints that one cell may hold before it is split by a further choice of blocks.
CELL = 4096
#: Splits of a cell: after three of them at most 14 of 64 bits are free, so a cell holds at most 2**14 fingerprints.
DEPTH = 3
PIVOTS = 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of a whole text: a bit is set if it is in over half of the shingles' XXH64. Zero if there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    run = b" ".join(words)
    votes, n = np.zeros(64, np.int64), 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(run, SEED)]
        pieces = [hashes]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts, ends = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        pieces = ([digest(run[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])] for k in range(0, len(starts), CHUNK))
    for hashes in pieces:
        h = np.array(hashes, np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row's whole text; a null text counts as empty."""

    def run(batches):
        for b in sliced(batches):
            yield pa.record_batch([b.column(0), pa.array([fingerprint(t, width) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col)).mapInArrow(run, f"id {kind}, fp long")


def fingerprinted(docs: DataFrame, text_col: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """docs with the fingerprint of every row's whole text as a last column; a null text counts as empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in sliced(batches):
            texts = b.column(at).cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t, width) for t in texts], pa.int64())], names=[*b.schema.names, "fp"])

    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    out = named.mapInArrow(run, ", ".join([*(f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes)), "fp long"]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("fp").alias(name))


def masks(free: list[int], radius: int) -> list[int]:
    """Choices of BLOCKS_KEPT of radius + BLOCKS_KEPT blocks of the free bits, each as a signed mask of the bits kept."""
    blocks = [[int(b) for b in x] for x in np.array_split(np.array(free), radius + BLOCKS_KEPT)]
    return [int(np.array(sum(1 << b for k in kept for b in blocks[k]), np.uint64).astype(np.int64)) for kept in combinations(range(len(blocks)), BLOCKS_KEPT)]


def finer(mask: int, radius: int) -> list[int]:
    """The masks that split a mask's cells: its bits and those of a choice of blocks of the bits that it leaves free."""
    return [mask | m for m in masks([b for b in range(64) if not (mask >> b) & 1], radius)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """n reference fingerprints, from fixed hashes."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {k}", SEED) for k in range(n)], np.uint64)


def survivors(cell: np.ndarray, fp: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of one cell within the radius, from the pivot table; cell is an id for each position.

    Rows are swept in the order of cell and distance to the first pivot. A pair leaves as soon as two coordinates differ by
    more than the radius (the triangle inequality), and what the table leaves is verified by its exact distance.
    """
    near = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((near[:, 0], cell))
    cell, near, fp = cell[order], near[order], fp[order]
    left, right, step = [], [], 1
    at = np.arange(len(fp) - 1)
    while len(at):
        at = at[at + step < len(fp)]
        to = at + step
        at = at[(cell[at] == cell[to]) & (near[to, 0] - near[at, 0] <= radius)]
        for k in range(0, len(at), 1 << 18):
            i = at[k : k + (1 << 18)]
            i = i[np.abs(near[i] - near[i + step]).max(axis=1) <= radius]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
            left.append(order[i])
            right.append(order[i + step])
        step += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions the smallest position that it reaches over pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect just what pairs of distinct fingerprints within the radius connect; fps has distinct fp.

    Cells are the values of the bits that a mask keeps, for ten masks such that fingerprints within the radius share a cell
    at least. A cell of over CELL fingerprints is split by further masks in the same manner, which loses no pair. Each task
    reads whole cells in order, filters their pairs by the pivot table and emits a spanning forest, at most a row for each
    fingerprint, not the pairs.
    """
    spark, refs, tree = fps.sparkSession, pivots(), {m: None for m in masks(list(range(64)), radius)}
    rows = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in tree])).alias("mask"))

    def compare(batches):
        held = None

        def edges(b):
            if not len(b[0]):
                return
            mask, fp = b
            new = np.ones(len(fp), bool)
            new[1:] = (mask[1:] != mask[:-1]) | ((fp[1:] & mask[1:]) != (fp[:-1] & mask[:-1]))
            cell = np.cumsum(new)
            several = np.bincount(cell)[cell] > 1
            if not several.any():
                return
            cell, fp = cell[several], fp[several]
            a, c = survivors(cell, fp.view(np.uint64), radius, refs)
            root = forest(a, c, len(fp))
            tied = root != np.arange(len(fp))
            if tied.any():
                yield pa.record_batch([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"])

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            mask, fp = held
            same = (mask == mask[-1]) & ((fp & mask) == (fp[-1] & mask[-1])) if len(fp) else np.zeros(0, bool)
            cut = len(fp) - int(same.sum())  # rows are sorted: the last cell may go on in the next batch
            if cut:
                yield from edges([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from edges(held)

    found = None
    for depth in range(DEPTH + 1):
        cells = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = cells.groupBy("mask", "key").count().where(F.col("count") > CELL).select("mask", "key") if depth < DEPTH else None
        if large is not None:
            large = written(large, "cells")
            if large.isEmpty():
                large = None
        small = cells if large is None else cells.join(large, ["mask", "key"], "left_anti")
        made = small.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").select("mask", "fp").mapInArrow(compare, "a long, b long")
        found = made if found is None else found.union(made)
        if large is None:
            break
        tree = {m: finer(m, radius) for m in (tree if depth == 0 else {x for kids in tree.values() for x in kids})}
        kids = spark.createDataFrame([(m, k) for m, ks in tree.items() for k in ks], "mask long, kid long")  # 10 ** (depth + 2) rows
        rows = written(cells.join(large, ["mask", "key"], "left_semi").select("mask", "fp").join(F.broadcast(kids), "mask").select("fp", F.col("kid").alias("mask")).distinct(), "rows")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, classes: bool = False) -> DataFrame:
    """(id, fp, component) for each row: the smallest id of the rows that links reach, its own included.

    With classes, a fourth column root: a fingerprint that stands for the class, which rows of one id may have several of.

    Null text: as empty. Empty or wordless text: fingerprint zero, linked like any other. Repeated rows: a row each. Null id:
    a row whose id takes no part in the minimum. Other columns are not read, so their names can't clash. Empty table: no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    each = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = written(connected(links(each.select("fp"), radius)), "roots")
    grouped = written(roots.join(each, roots.node == each.fp).groupBy("root").agg(F.min("least").alias("low")), "groups")
    kept = ["root"] if classes else []
    linked = roots.join(grouped, "root").select(F.col("node").alias("fp"), "low", *kept)
    # Tables of their own, so that both sides of a join are exchanges, whose hot roots and fingerprints adaptive execution splits.
    smallest = written(each.join(linked, "fp", "left").select("fp", F.coalesce("low", "least").alias("component"), *[F.coalesce(k, "fp").alias(k) for k in kept]), "components")
    return rows.join(smallest, "fp", "left").select("id", "fp", "component", *kept)
