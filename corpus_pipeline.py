"""The corpus pipeline: quality, near duplicates, repeated passages, packing; each stage on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.packing import pack
from tessera.llm.quality import quality_scores
from tessera.llm.queries import tokenizer_file
from tessera.llm.simhash import fingerprinted, near_duplicates
from tessera.llm.substring import remove_repeats

CUT = 0.3
SEQUENCE = 2048


def own(docs: DataFrame) -> list:
    """The columns of docs, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least CUT; the others go.

    Null text: scored as an empty one. Repeated rows: equal texts alike. Null id: scored like any other. No labels at all: every
    score is one half, so all stay. Other columns pass, whatever their names. Empty table: no rows.
    """
    names = (free(docs, "_score"), free(docs, "_predicted"))
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), cut=CUT, keep=True, names=names)
    return scored.where(F.col(names[1]) == 1).select(*own(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id. Rows of null id can't be told apart: all stay.

    Rows of one id whose texts are of several classes are documents of their own: each class keeps one. Of a class's rows of its
    smallest id, one of the smallest fingerprint stays. Null and empty texts are one class. Other columns pass, whatever their
    names. Empty table: no rows.
    """
    found = near_duplicates(docs, classes=True).where("id = component")
    mark = free(docs, "_fp")
    keep = found.groupBy("root").agg(F.min("id").alias("doc_id"), F.min("fp").alias(mark)).select("doc_id", mark)
    alone = docs.where("doc_id is null")
    rows = fingerprinted(docs.where("doc_id is not null"), name=mark)
    first = rows.join(keep, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return first.select(*own(docs)).union(alone)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that start in a smaller id too; n_chars follows the text.

    Null text: becomes an empty one. Repeated rows and null ids: nothing of theirs goes for each other's sake. Other columns pass,
    whatever their names. Empty table: no rows.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    found = remove_repeats(docs).toDF("_words", "_removed", *names)
    kept = found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in a sequence of at most SEQUENCE ids.

    Null or empty text: the end id alone. Repeated rows and null ids: packed like any other. Other columns are not read. Empty
    table: no rows.
    """
    return pack(docs, tokenizer_file("word_bpe_49k.json"), SEQUENCE).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


STAGES = [("quality", quality), ("near_duplicates", near), ("substrings", substrings), ("packing", packed)]

#: Fingerprints, scores and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep of documents; each stage is a table before the next begins. Empty table: no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
