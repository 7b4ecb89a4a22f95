import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

from tessera.llm import substring
from tessera.llm.lm import lm_scores


class Plain:
    """PPM over dictionaries: contexts tried from the longest down, symbols seen in longer ones excluded."""

    def __init__(self, texts, order, least):
        self.order, self.grams, self.total = order, Counter(), 0
        for t in texts:
            s = list(t) + [255]
            self.total += len(s)
            for i in range(len(s)):
                for k in range(1, order + 2):
                    if i + k <= len(s):
                        self.grams[tuple(s[i : i + k])] += 1
        self.next = defaultdict(dict)
        for g, n in self.grams.items():
            if n >= least:
                self.next[g[:-1]][g[-1]] = n

    def log(self, context, symbol):
        out, gone, started = 0.0, set(), False
        for k in range(min(self.order, len(context)), -1, -1):
            c = tuple(context[len(context) - k :]) if k else ()
            if not self.next.get(c):
                continue
            total = self.grams[c] if c else self.total
            rest = total - sum(self.next[c].values())
            left = {s: n for s, n in self.next[c].items() if s not in gone}
            size = sum(left.values()) + rest
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / size)
            if size:
                out += math.log10((len(left) / 2 + rest) / size)
            gone |= set(left)
        return out - math.log10(max(1, 255 - len(gone)))

    def score(self, text):
        s = list(text) + [255]
        return sum(self.log(s[:i], s[i]) for i in range(len(s)))


def brute(rows, order, share):
    texts = [(t or "").encode() for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    train = [t for t, h in zip(texts, held) if not h]
    size = sum(len(t) + 1 for t in train)
    model = Plain(train, order, max(1, math.ceil(share * size)))
    counts = Counter()
    for t in train:
        counts.update(t.lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (d, _), t, h in zip(rows, texts, held):
        toks = t.lower().split() + [None]
        out.append((d, h, len(toks), sum(counts[x] > 0 for x in toks), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in toks), model.score(t)))
    return sorted(out, key=repr)


def check(spark, rows, order, share):
    df = spark.createDataFrame([(d, t, 0.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted((tuple(r) for r in lm_scores(df, order=order, share=share).collect()), key=repr)
    want = brute(rows, order, share)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-4, abs_tol=1e-4), (g, w)


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 2000)
    rng = random.Random(4)
    words = ["the", "of", "and", "naïve", "tion", "ing", "Über", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "the the"), (103, "qqq \x00 zzz 中"), (104, "the of " * 1500), rows[3], rows[9]]
    check(spark, rows, 3, 1e-9)
    check(spark, rows, 5, 2e-3)
    check(spark, rows, 1, 5e-2)


def test_empty_tables(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    (r,) = lm_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert r["held_out"] and (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 2) and math.isclose(r["score"], -3 * math.log10(255), rel_tol=1e-6) and r["base_score"] == 0


def test_beats_the_base_on_held_out_text(spark, sf):
    """On training text at any size; on held-out text once there is enough to learn from (of sf0.001 and sf0.01 there is not)."""

    def sums(path):
        rows = lm_scores(spark.read.parquet(f"{path}/documents.parquet")).collect()
        assert np.isfinite([r["score"] for r in rows]).all()
        return {h: [sum(r[c] for r in rows if r["held_out"] == h) for c in ("score", "base_score")] for h in (False, True)}

    score, base = sums(sf)[False]
    assert score > 0.96 * base and score > base
    large = Path(sf).parent / "sf0.1"
    if large.exists():
        found = sums(large)
        for score, base in found.values():
            assert score > base
        assert found[True][0] > 0.99 * found[True][1]


def test_a_very_long_text_at_full_order(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(40)]
    long = " ".join(rng.choice(words) for _ in range(12_000))
    rows = [(1, long), (2, "word1 word2"), (3, "word3 é\x00" * 300), (4, None)]
    check(spark, rows, 5, 1e-12)


def test_every_sequence_that_occurs_is_known(spark):
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    many = [(1000 + i, f"{i} " * 2000) for i in range(800)]  # some 6 MB: what occurs once is below 4e-7 of them
    rare = [(next(d for d in range(100) if not out(d)), "quixotic zephyr"), (next(d for d in range(100) if out(d)), "quixotic zephyr")]
    got = lm_scores(spark.createDataFrame(many + rare, "doc_id long, text string").repartition(3)).collect()
    train = ["quixotic zephyr".encode()] + [t.encode() for d, t in many if not out(d)]
    least = 4e-7 * sum(len(t) + 1 for t in train)
    assert least > 2
    want = Plain(train[:1] + [t[:40] for t in train[1:]], 5, 1)  # whole contexts of the rare text: those of letters occur in it alone
    (r,) = [r for r in got if r["id"] == rare[1][0]]
    letters = sum(want.log(rare[1][1].encode()[:i], rare[1][1].encode()[i]) for i in range(1, 15))
    assert letters > -6 and letters - 9 < r["score"] < letters


def test_contexts_take_little_memory():
    """Repetitive texts: their codes are numbered in at most 32 bytes for each byte of them, as np.unique() does in 49."""
    import tracemalloc

    from tessera.llm.lm import Contexts
    from tessera.llm.ppm import codes_of, numbered

    texts = [np.random.default_rng(k).integers(97, 103, 1000).astype(np.uint8).tobytes() for k in range(1000)]
    tracemalloc.start()
    c = Contexts(texts, 5, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * 1001 * 1000
    every = codes_of(texts, 5)
    assert (np.sort(c.codes)[c.place] == every).all()
    for codes in (every, every[:1], every[:0]):
        want = np.unique(codes, return_inverse=True)
        assert all((a == b).all() for a, b in zip(numbered(codes.copy()), want))
