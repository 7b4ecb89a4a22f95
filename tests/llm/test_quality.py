import math
import zlib

import numpy as np
import xxhash

from tessera.llm.quality import BITS, Codes, calibrated, features, fitted, margin, quality_scores, shape


def plain_features(text):
    """The indicators of a text, one by one, as a set of slots."""
    words, whole, out = text.split(), 2**64, set()
    if not words:
        return {0}
    mix, top = 0x9E3779B97F4A7C15, 2**BITS
    slot = lambda v: (v * mix % whole) * top // whole
    code = [xxhash.xxh64_intdigest(w) >> 24 for w in words]
    look = [0x5A5A5A if k and words[k - 1] == w else xxhash.xxh64_intdigest(shape(w)) & 0xFFFFFF for k, w in enumerate(words)]
    for k, c in enumerate(code):
        out.add(slot(c * mix % whole))
        if k:
            out.add(slot((code[k - 1] * 31 + c + 7) * mix % whole))
    for size in (1, 2, 3):
        grams = []
        for k in range(len(look) - size + 1):
            g = look[k]
            for x in look[k + 1 : k + size]:
                g = (g * 1000003 + x) % whole
            grams.append(g)
        for g in set(grams):
            base = (g + size * 77) * 0xC2B2AE3D27D4EB4F % whole
            out.add(slot(base))
            for j, share in enumerate((0.5, 0.125, 0.03125)):
                if grams.count(g) >= share * len(grams):
                    out.add(slot((base ^ (j + 1)) * mix % whole))
    return out


def plain_fit(rows, good):
    """Naive Bayes support vectors over dictionaries: log-count ratios, then the dual of the hinge loss, a row at a time."""
    counts = {g: {} for g in (True, False)}
    for r, g in zip(rows, good):
        for s in r:
            counts[g][s] = counts[g].get(s, 0) + 1
    total = {g: 2**BITS + sum(c.values()) for g, c in counts.items()}
    n = lambda g, s: 1 + counts[g].get(s, 0)
    ratio = {s: math.log(n(True, s) / total[True]) - math.log(n(False, s) / total[False]) if n(True, s) + n(False, s) > 3 else 0.0 for g in counts for s in counts[g]}
    scaled = []
    for r in rows:
        size = math.sqrt(sum(ratio[s] ** 2 for s in r)) or 1e-12
        scaled.append({s: ratio[s] / size for s in r})
    up = sum(good)
    cost = [len(rows) / (2 * (up if g else len(rows) - up)) for g in good]
    w, bias, alpha, rng = {}, 0.0, [0.0] * len(rows), np.random.default_rng(0)
    for _ in range(12):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            y = 1 if good[i] else -1
            slope = y * (sum(w.get(s, 0.0) * x for s, x in scaled[i].items()) + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), cost[i])
            step, alpha[i] = (new - alpha[i]) * y, new
            for s, x in scaled[i].items():
                w[s] = w.get(s, 0.0) + step * x
            bias += step
            moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return lambda r: sum(w.get(s, 0.0) * ratio.get(s, 0.0) for s in r) / (math.sqrt(sum(ratio.get(s, 0.0) ** 2 for s in r)) or 1e-12) + bias


def plain_scores(docs, labels, sample=8000):
    """Scores of (id, text) rows by a model of the labels whose bucket is not 0; all labels are fewer than sample."""
    known = {d: g for d, g in labels if d is not None and g is not None and zlib.crc32(str(d).encode()) % 5}
    assert len(known) <= sample
    each = [plain_features((t or "").encode()) for _, t in docs]
    rows = [(r, known[d] > 0) for (d, _), r in zip(docs, each) if d in known]
    rows.sort(key=lambda x: (x[1], xxhash.xxh64_intdigest(np.array(sorted(x[0]), "<i8").tobytes())))
    found, good = [r for r, _ in rows], [g for _, g in rows]
    order = sorted(range(len(rows)), key=lambda k: good[k])
    fold = {k: j % 2 for j, k in enumerate(order)}
    margins = [0.0] * len(rows)
    for f in (0, 1):
        there = [k for k in range(len(rows)) if fold[k] != f]
        told = plain_fit([found[k] for k in there], [good[k] for k in there])
        for k in fold:
            if fold[k] == f:
                margins[k] = told(found[k])
    slope, offset = calibrated(np.array(margins), np.array(good))
    told = plain_fit(found, good)
    return [1 / (1 + math.exp(-min(max(slope * told(r) + offset, -30), 30))) for r in each]


def test_like_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**6, None), (10**6 + 1, "x " * 500 + "y"), (None, "Some text, 12 of it."), (0, "again 0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality_scores(df, labels, keep=True).collect()}
    want = plain_scores(rows, [(r["doc_id"], r["quality"]) for r in labels.collect()])
    for row, p in zip(rows, want):
        assert abs(got[row] - p) < 1e-6, (row, got[row], p)


def test_features_like_brute_force():
    rng = np.random.default_rng(4)
    words = ["a", "b", "The", "x9", "--", "é", "long" * 50, "The"]
    for n in (0, 1, 2, 3, 40):
        text = " ".join(words[k] for k in rng.integers(0, len(words), n)).encode()
        assert features(text, Codes()).tolist() == sorted(plain_features(text))


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert np.mean([got[d]["predicted"] == truth[d] for d in held]) >= 0.85


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "z"), (1, "a b c", "z"), (2, None, "z"), (3, "", "z"), (None, "a b c", "z"), (4, "x " * 50000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (9, 0), (None, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["id"] == 1}) == 1
    kept = quality_scores(docs.select("doc_id", "text", F_lit()), labels, keep=True)
    assert kept.columns == ["doc_id", "text", "other", "score", "predicted"] and kept.count() == 6
    none = quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_scores(docs.limit(0), labels).collect() == []


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("k").alias("other")


def test_descent_separates():
    codes = Codes()
    rows = [features(t.encode(), codes) for t in ["good words here"] * 3 + ["fine words there"] * 3 + ["bad!! bad!! bad!!"] * 3 + ["worse!! no!!"] * 3]
    good = np.array([True] * 6 + [False] * 6)
    w, s = fitted(rows, good)
    assert all((margin(r, w, s) > 0) == g for r, g in zip(rows, good))


def test_shape_is_of_the_whole_word():
    def plain(word):
        out = []
        for c in word:
            s = 97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c
            if not out or out[-1] != s:
                out.append(s)
        return bytes(out)

    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 63, 64, 65, 5000):
        for _ in range(20):
            word = rng.integers(0, 256, n).astype(np.uint8).tobytes()
            assert shape(word) == plain(word)
    assert shape(b"a" * 64 + b"Z9-") == b"aA9-" and shape(("中文" * 40 + "ab,12").encode()) == b"a,9"
