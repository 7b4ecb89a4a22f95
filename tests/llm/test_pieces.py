import random

import numpy as np
import public_tokenizers
from sentencepiece import SentencePieceProcessor

from tessera.llm.pieces import SPACE, Pieces, encoded, held

FILE = public_tokenizers.path("piece_bpe_32k.model")


def test_documents_like_the_library(spark, sf):
    sp = SentencePieceProcessor(model_file=FILE)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in encoded(docs, FILE).collect():
        assert r["ids"] == sp.encode(texts[r["id"]]) and r["whole"] and r["n_ids"] == len(r["ids"])


def test_odd_texts_like_the_library():
    sp, mine = SentencePieceProcessor(model_file=FILE), held(FILE)
    rng = random.Random(0)
    bits = ["a", "b", " ", "  ", "the", "tion", "ing", "é", "\n", "\t", "中", "😀", "<s>", "</s>", SPACE, "0", "19", ".", ",", "      ", "É", "un", "qz"]
    texts = ["", " ", "a", "Hello  world\n a\tb   é<s>😀 ", "x" * 500] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(97, 122), rng.randint(192, 591), rng.randint(0x400, 0x460)])) for _ in range(rng.randint(1, 20))) for _ in range(4000)]
    for t, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(t), t
        assert mine.decode(ids).decode() == sp.decode(sp.encode(t)), t


def test_runs_of_spaces_like_the_library():
    import time

    sp, mine = SentencePieceProcessor(model_file=FILE), held(FILE)
    assert mine.stride > 1
    texts = [" " * n + tail for n in (*range(150), 1000, 5001) for tail in ("", "the x", "\n", "é", "中 ", "q" * 40)]
    texts += ["a" + " " * n + "b" + " " * (2 * n) for n in range(90)] + ["x" * 3000, "   " + "xyz" * 4000]
    for t, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(t), (len(t), t[-5:])
    long = " " * 1_000_000 + "end"
    began = time.perf_counter()
    (ids,) = mine.encode([long])
    assert time.perf_counter() - began < 1
    assert np.frombuffer(ids, "<i4").tolist() == sp.encode(long) and mine.decode(ids).decode() == long


def test_merges_like_one_by_one():
    mine, rng = held(FILE), random.Random(9)

    def plain(word):
        parts = list(word)
        while True:
            some = [(-mine.score[mine.ids[p + q]], k) for k, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in mine.ids]
            if not some:
                return [mine.ids.get(p, -1) for p in parts]
            k = min(some)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for _ in range(400):
        w = SPACE * rng.randint(0, 40) + "".join(rng.choice("abcdeting é中") for _ in range(rng.randint(0, 20))).replace(" ", SPACE)
        assert mine.merged(w) == plain(w)


def test_best_scores_of_the_model_file(spark):
    """The Viterbi path over the file's own scores, against all segmentations."""
    m = held(FILE, True)
    rng = random.Random(4)
    words = ["".join(rng.choice("theinga ") for _ in range(rng.randint(1, 9))) for _ in range(200)]

    def best(w):
        top = {0: 0.0}
        for k in range(1, len(w) + 1):
            top[k] = max(top[s] + m.score[m.ids[w[s:k]]] for s in range(k) if s in top and w[s:k] in m.ids)
        return top[len(w)]

    got = {r["id"]: r for r in encoded(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), FILE, best=True).collect()}
    for i, w in enumerate(words):
        assert got[i]["whole"] and np.isclose(sum(m.score[x] for x in got[i]["ids"]), sum(best(u) for u in m.units(w)))


def test_scores_take_the_best_path():
    rng = random.Random(3)
    pieces = [("<unk>", 0.0)] + [(p, -rng.random() * 5 - 1) for p in ["a", "b", "c", SPACE, SPACE + "a", "ab", "bc", "abc", "ca", SPACE + "ab", "cab", "bca"]]
    m = Pieces(pieces, merges=False, unknown=0, plain=[False] + [True] * 12)
    score = dict(pieces)

    def best(w):
        top = {0: (0.0, [])}
        for k in range(1, len(w) + 1):
            top[k] = max((top[k - n][0] + score[w[k - n : k]], top[k - n][1] + [w[k - n : k]]) for n in range(1, k + 1) if w[k - n : k] in score and k - n in top)
        return top[len(w)]

    words = sorted({SPACE + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    for w, ids in m.walk(words).items():
        got = [m.text[i] for i in np.frombuffer(ids, "<i4").tolist()]
        assert "".join(got) == w and abs(sum(score[p] for p in got) - best(w)[0]) < 1e-9
    assert np.frombuffer(m.walk(["azza"])["azza"], "<i4").tolist() == [1, 0, 1]


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "q"), (1, None, "q"), (2, "", "q"), (None, "a", "q"), (3, "a " * 30000, "q"), (4, SPACE, "q")], "doc_id long, text string, ids string")
    got = {(r["id"], r["n_ids"], r["whole"]) for r in encoded(df, FILE).collect()}
    assert got == {(1, 0, True), (2, 0, True), (None, 1, True), (3, 30001, True), (4, 1, False)}
    assert encoded(df.limit(0), FILE).collect() == []
