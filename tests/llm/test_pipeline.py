import zlib

import numpy as np
import pytest
from pyspark.sql.functions import lit
from test_packing import FILE  # noqa: F401  beside this file
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, sf), name)
        seen.append(now)
        if name != "packing":
            assert now.columns == docs.columns
    good, near, cut, out = [{r[0]: r for r in x.collect()} for x in seen[:3]] + [seen[3].collect()]
    assert 0 < len(near) <= len(good) < len(texts) and set(near) == set(cut)
    from test_simhash import brute as near_brute
    from test_substring import brute as cut_brute

    assert set(near) == {d for d, _, c in near_brute([(d, r["text"]) for d, r in good.items()]) if d == c}
    want = {d: t for d, _, _, t in cut_brute([(d, r["text"]) for d, r in near.items()], 13)}
    assert {d: r["text"] for d, r in cut.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    tok = Tokenizer.from_file(FILE)
    ids = {d: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for d, t in want.items()}
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in out} == {(d, k, len(x[k : k + 2048]), zlib.crc32(x[k : k + 2048].tobytes())) for d, x in ids.items() for k in range(0, len(x), 2048)}


def test_rows_repeated_or_without_id(spark, sf):
    df = spark.createDataFrame([(1, "a b c d", "en"), (1, "a b c d", "en"), (2, "a b c d", "en"), (None, "a b c d", "en")], "doc_id long, text string, lang string")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in corpus_pipeline.near(spark, df, sf).collect()) == [(False, 1), (True, None)]


def test_one_id_with_texts_of_several_classes(spark, sf):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "quite another text"), (5, "quite another text"), (5, "and a third one here"), (7, "and a third one here"), (3, "p q r s t"), (3, "u v w x y")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.near(spark, df, sf)
    assert got.columns == df.columns
    want = [(1, "a b c d"), (3, "p q r s t"), (3, "u v w x y"), (5, "and a third one here"), (5, "quite another text")]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_odd_rows_and_clashing_columns(spark, sf):
    same, other = (" ".join(f"{w}{k}" for k in range(n)) for w, n in (("word", 30), ("other", 90)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, same), (5, f"{other} {same}"), (6, "long " * 100_000), (None, same), (None, None), (4, same)]
    names = ["predicted", "score", "_predicted", "fp", "id", "c0", "n_words", "n_removed", "block", "length", "a.b", "_fp"]
    df = spark.createDataFrame([(d, t, *range(len(names))) for d, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)).withColumn("n_chars", lit(7))
    extra = tuple(range(len(names)))
    now, left = df, []
    for name, stage in corpus_pipeline.STAGES[1:3]:
        now = corpus_pipeline.written(stage(spark, now, sf), name)
        assert now.columns == df.columns
        left.append(now.collect())
    near, cut = left
    # 1, 2 and 3 are one class; the two rows of 4 are one document; rows without id stay
    assert sorted(((r["doc_id"], r["text"]) for r in near), key=repr) == sorted([(1, None), (4, same), (5, f"{other} {same}"), (6, "long " * 100_000), (None, same), (None, None)], key=repr)
    assert {r["doc_id"]: r["text"] for r in cut if r["doc_id"]} == {1: "", 4: same, 5: other, 6: ("long " * 100_000).strip()}
    assert all(tuple(r)[2:-1] == extra and r["n_chars"] == len(r["text"]) for r in cut)
    out = corpus_pipeline.packed(spark, now, sf).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 1 and len([r for r in out if r["doc_id"] == 6]) == -(-100_001 // 2048)
    kept = corpus_pipeline.quality(spark, df, sf)
    assert kept.columns == df.columns and all(tuple(r)[2:-1] == extra for r in kept.collect())


def test_empty_table(spark, sf):
    now = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, sf), name)
        assert now.count() == 0


def test_quality_stage_is_the_classifier(spark, sf):
    from test_quality import plain_scores

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_scores(rows, [(r["doc_id"], r["quality"]) for r in labels.collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    assert kept == {d for (d, _), p in zip(rows, want) if p >= corpus_pipeline.CUT}
