"""Quality classifier: n-gram indicators scaled by class log-count ratios under a linear hinge-loss model (NB-SVM)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, utf8

BITS = 18
#: Labelled rows that the model is fit on at most, those of the smallest hash of their id: a bounded sample by design.
SAMPLE = 8000
CACHED = 200_000
#: Bytes of a word whose code is cached at most; longer ones are worked out each time.
LONG = 64
SAME = 0x5A5A5A
#: Shape n-grams count at each of these shares of a text's n-grams that they reach.
SHARES = (0.5, 0.125, 0.03125)
MIX = np.uint64(0x9E3779B97F4A7C15)


#: What stands for each byte in a shape.
SIGNS = bytes(97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """Lower letters, capitals and digits as one sign each, other ASCII bytes as they are, runs of a sign once; of the whole word."""
    return RUN.sub(rb"\1", word.translate(SIGNS))


class Codes(dict):
    """40 bits of a word's hash above 24 bits of its shape's."""

    def __missing__(self, word):
        v = (xxhash.xxh64_intdigest(word) >> 24 << 24) | (xxhash.xxh64_intdigest(shape(word)) & 0xFFFFFF)
        if len(word) <= LONG:
            if len(self) > CACHED:
                self.clear()
            self[word] = v
        return v


def features(text: bytes, codes: Codes) -> np.ndarray:
    """Sorted slots below 2**BITS of a whole text's indicators: words, word pairs, and shape n-grams by their share.

    A word that repeats the one before it has a shape of its own. A text without words has one indicator.
    """
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(1, np.int64)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, n)
    word = code >> np.uint64(24)
    look = code & np.uint64(0xFFFFFF)
    look[1:][word[1:] == word[:-1]] = SAME
    found = [word * MIX, (word[:-1] * np.uint64(31) + word[1:] + np.uint64(7)) * MIX]
    gram = look.copy()
    for size in (1, 2, 3):
        if n < size:
            break
        if size > 1:
            gram = gram[:-1] * np.uint64(1000003) + look[size - 1 :]
        each, count = np.unique(gram, return_counts=True)
        base = (each + np.uint64(size * 77)) * np.uint64(0xC2B2AE3D27D4EB4F)
        found.append(base ^ np.uint64(0))
        for k, share in enumerate(SHARES):
            found.append((base[count >= share * len(gram)] ^ np.uint64(k + 1)) * MIX)
    return np.unique((np.concatenate(found) * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def fitted(rows: list[np.ndarray], good: np.ndarray, rounds: int = 12, c: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, squared ratios) of the slots: log-count ratios, then dual coordinate descent on the hinge loss."""
    size = 1 << BITS
    counts = []
    for side in (True, False):
        mine = [r for r, g in zip(rows, good) if g == side]
        counts.append(1 + np.bincount(np.concatenate(mine), minlength=size).astype(np.float64))
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    ratio[(counts[0] + counts[1]) <= 3] = 0  # seen once: says nothing of other rows
    vectors = []
    for r in rows:
        x = ratio[r]
        vectors.append(x / max(np.sqrt(x @ x), 1e-12))
    y = np.where(good, 1.0, -1.0)
    cost = c * np.where(good, len(y) / (2 * good.sum()), len(y) / (2 * (~good).sum()))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slots, x = rows[i], vectors[i]
            slope = y[i] * (w[slots] @ x + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), cost[i])  # squared norm: 1 for the row and 1 for the bias
            step = (new - alpha[i]) * y[i]
            if step:
                w[slots] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.concatenate([w * ratio, [bias]]), ratio * ratio


def margin(slots: np.ndarray, weights: np.ndarray, squares: np.ndarray) -> float:
    return float(weights[slots].sum() / max(np.sqrt(squares[slots].sum()), 1e-12) + weights[-1])


def calibrated(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps towards smoothed targets."""
    up, down = good.sum(), (~good).sum()
    t = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(q * margins * margins).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def trained(rows: list[np.ndarray], good: np.ndarray):
    """(weights, squares, slope, offset); the curve is fit on margins of rows that the model behind them has not seen.

    No rows: a score of one half for all. Rows of one class: its smoothed share for all.
    """
    size = 1 << BITS
    up, down = int(good.sum()), int((~good).sum())
    if min(up, down) < 2:
        rate = (up + 1) / (up + down + 2)
        return np.zeros(size + 1), np.zeros(size), 0.0, float(np.log(rate / (1 - rate)))
    order = np.argsort(good, kind="stable")
    fold = np.empty(len(good), np.int64)
    fold[order] = np.arange(len(good)) % 2
    out = np.zeros(len(good))
    for f in (0, 1):
        there = np.flatnonzero(fold != f)
        w, s = fitted([rows[i] for i in there], good[there])
        for i in np.flatnonzero(fold == f):
            out[i] = margin(rows[i], w, s)
    w, s = fitted(rows, good)
    return (w, s, *calibrated(out, good))


def bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, cut: float = 0.3, keep: bool = False, sample: int = SAMPLE, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs; with keep, docs' own columns stand before score and predicted, whose
    names can be chosen so that they don't clash.

    Learns only from labels whose id's bucket is not 0, at most sample of them; labels and ids are no inputs of a score.
    Null text: as empty. Empty texts have an indicator of their own. Null labels: left out. Labels of ids that docs lacks: left
    out. Repeated rows: each is scored, equal texts alike. Null id: held out. Other columns are not read (keep: passed on).
    Empty docs: no rows. No labels at all: every score is one half.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).where("id is not null and good is not null").where(bucket("id", folds) != 0)
    chosen = known.orderBy(F.xxhash64("id"), "id", "good").limit(sample)  # sample rows at most, so its size is known

    def extract(batches):
        codes = Codes()
        for b in sliced(batches):
            yield pa.record_batch([b.column(0), pa.array([features(t, codes).astype("<i4").tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["good", "slots"])

    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    learnt = texts.join(F.broadcast(chosen), "id").select("good", "text").mapInArrow(extract, "good int, slots binary").toArrow()
    rows = [np.frombuffer(x, "<i4").astype(np.int64) for x in learnt["slots"].to_pylist()]
    good = np.array(learnt["good"].to_pylist(), np.int64) > 0
    order = np.lexsort(([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], good)) if rows else []
    w, s, slope, offset = trained([rows[i] for i in order], good[order] if rows else good)
    model = spark.sparkContext.broadcast((w.astype(np.float64), s, slope, offset))  # 2 ** BITS slots, whatever the corpus

    at = docs.columns.index(text_col) if keep else 0  # kept rows hold their text once

    def score(batches):
        weights, squares, a, b = model.value
        codes = Codes()
        for batch in sliced(batches):
            m = np.array([margin(features(t, codes), weights, squares) for t in batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            kept = range(0 if keep else 1, batch.num_columns)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[*(batch.schema.names[k] for k in kept), "score", "predicted"])

    if keep:
        named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
        schema = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes)) + ", score double, predicted int"
        out = named.mapInArrow(score, schema)
        return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("score").alias(names[0]), F.col("predicted").alias(names[1]))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"), (bucket(id_col, folds) == 0).alias("held_out"))
    return slim.mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int")
