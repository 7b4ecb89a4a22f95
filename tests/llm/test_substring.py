import random
from decimal import Decimal

import numpy as np

from tessera.llm import substring
from tessera.llm.fmindex import FMIndex, interval_minima
from tessera.llm.substring import remove_repeats


def brute(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    owner = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if d is not None:
                owner[k] = min(d, owner.get(k, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and owner[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 3000)
    monkeypatch.setattr(substring, "INDEX", 20)
    monkeypatch.setattr(substring, "CROWDED", 5)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "ß"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 60))] for _ in range(8)]
    rows = [(4, None), (5, ""), (6, "a b"), (None, " ".join(passages[0])), (None, "x")]
    for d in range(10, 70):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        rows.append((d, " \t".join(w) + "\n"))
    rows += rows[8:14] + [(d + 100, t) for d, t in rows[20:26]] + [(3, "the " * 400), (2, "the " * 30)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, block string, id int").repartition(3)
    for size in (13, 4):
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in remove_repeats(df, size=size).collect()), key=repr)
        assert got == brute(rows, size)


def test_a_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 2000)
    monkeypatch.setattr(substring, "CROWDED", 8)
    rng = random.Random(8)
    hot = [f"hot{k}" for k in range(30)]
    own = lambda: [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(0, 25))]
    rows = [(d, " ".join(own() + hot + own())) for d in rng.sample(range(1000), 200)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, gram string").repartition(4)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in remove_repeats(df).collect()), key=repr)
    assert got == brute(rows, 13) and sum(r[2] for r in got) >= 199 * 30


def test_ids_of_other_types(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 500)
    same = " ".join(f"w{k}" for k in range(20))
    for kind, ids in (("string", ["10", "9", "a", "b:1", "", "é", None]), ("double", [1.5, -2.0, float("inf"), 0.25, None]), ("long", [2**63 - 1, -(2**63), 0, None]), ("int", [5, -5, None]), ("decimal(30,2)", [Decimal("1e20"), Decimal("-0.01"), None])):
        rows = [(i, f"{same} x{k}") for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
        got, rows = remove_repeats(df), [tuple(r) for r in df.collect()]
        assert dict(got.dtypes)["doc_id"] == dict(df.dtypes)["doc_id"]
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()), key=repr) == brute(rows, 13)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(40)]
    text, ends = np.concatenate(seqs), np.cumsum([len(s) for s in seqs])
    fm = FMIndex(text, ends)
    for length in (1, 2, 3, 5):
        grams = {tuple(s[i : i + length].tolist()) for s in seqs for i in range(len(s) - length + 1)} | {(4,) * length}
        p = np.array(sorted(grams))
        lo, hi = fm.search(lambda k: p[:, k], length)
        for g, a, b in zip(p.tolist(), lo.tolist(), hi.tolist()):
            assert max(0, b - a) == sum(s[i : i + length].tolist() == g for s in seqs for i in range(len(s) - length + 1))
    value = np.array([3, 1, 2, 0])
    assert interval_minima(lambda at: value[at], np.array([0, 2, 0]), np.array([2, 3, 2])).tolist() == [1, 2, 1]
    # every suffix's sequence is found again from the samples
    each = fm.sequences(np.arange(fm.n))
    assert np.bincount(each).tolist() == [len(s) + 1 for s in seqs]
    lo, hi = fm.search(lambda k: np.array([1]), 1)
    assert sorted(fm.sequences(np.arange(lo[0], hi[0])).tolist()) == [k for k, s in enumerate(seqs) for x in s if x == 1]


def test_matching_statistics_like_brute_force():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(1, 4, rng.integers(1, 25)) for _ in range(20)]
    fm = FMIndex(np.concatenate(seqs), np.cumsum([len(s) for s in seqs]))

    def places(p):
        return sum(s[i : i + len(p)].tolist() == p for s in seqs for i in range(len(s) - len(p) + 1))

    for own, texts in ((1, seqs), (0, [rng.integers(1, 4, 30) for _ in range(5)])):
        for text in texts:
            for most in (3, 8):
                last = np.arange(most - 1, len(text))
                length, lo, hi = fm.statistics(lambda k, some: text[last[some] - k], most, len(last), own)  # noqa: B023
                for e, n, a, b in zip(last.tolist(), length.tolist(), lo.tolist(), hi.tolist()):
                    want = max((k for k in range(1, most + 1) if places(text[e - k + 1 : e + 1].tolist()) > own), default=0)
                    assert n == want and (n < most or b - a == places(text[e - most + 1 : e + 1].tolist()))
