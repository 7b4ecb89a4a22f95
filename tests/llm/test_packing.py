import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import WordIds, fractional, pack, plan

FILE = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, size):
    tok = Tokenizer.from_file(FILE)
    want = []
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), size):
            part = np.array(ids[k : k + size], "<u4")
            want.append((d, k // size, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted([tuple(r[:5]) for r in rows], key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(by), -(-sum(w[3] for w in want) // size)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack(docs, FILE).collect()
    n, least = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert n <= least + max(2, least // 50)


def test_edge_rows(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "it's <|endoftext|>x <|startoftext|> É é   d'été's\x1cq 　"), (4, "word " * 300), (5, "Ω" * 70), (6, " \n\t")]
    df = spark.createDataFrame([(d, t, 5) for d, t in texts], "doc_id long, text string, length int")
    check(pack(df, FILE, size=64).collect(), texts, 64)
    assert pack(df.limit(0), FILE).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="supported"):
        WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert WordIds(FILE).ids(b"Hello hello") == 2 * WordIds(FILE).ids(b"hello")


def test_a_very_long_text_at_full_size(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("abcdeé1-") for _ in range(rng.randint(1, 9))) for _ in range(120_000)) + " " + "z" * 20_000
    texts = [(1, long), (2, "a"), (2, "a"), (None, None)]
    n, least = check(pack(spark.createDataFrame(texts, "doc_id long, text string"), FILE).collect(), texts, 2048)
    assert n <= least + 1


def test_short_pieces_are_in_the_program():
    hist = {3: 5000, 7: 3000, 60: 10}
    used = {n for config, _ in fractional(hist, 128) for n in config}
    assert used == {3, 7, 60}
    assert sum(t for _, t in plan(hist, 128)) <= -(-sum(n * c for n, c in hist.items()) // 128) + 1


def test_plans_use_each_piece_once_and_are_tight():
    rng = random.Random(2)
    for n in (1, 5, 300, 5000):
        hist = {}
        for _ in range(n):
            k = min(128, max(1, int(rng.expovariate(1 / 30))))
            hist[k] = hist.get(k, 0) + 1
        groups = plan(hist, 128)
        used = {}
        for config, times in groups:
            assert sum(a * b for a, b in config.items()) <= 128
            for a, b in config.items():
                used[a] = used.get(a, 0) + b * times
        assert used == hist
        assert sum(t for _, t in groups) <= -(-sum(a * b for a, b in hist.items()) // 128) + 1 + n // 500
