"""What the training-data operators share: shared folders, materialised tables, byte-level words, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import shared_path
from ..sources.blocks import sliced

__all__ = ["WORD_PATTERN", "coded_id", "connected", "decoded_id", "dropped", "shared_path", "sliced", "table", "text_bytes", "utf8", "written"]

#: Characters that separate words: 0x20 and 0x09-0x0D, which is what bytes.split() splits at.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: While a table is written: the job's shuffle files go once it is done, and Arrow batches have few rows, as texts may be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost only a reread. The settings of WRITING hold for
    the job alone, and are put back as they were."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        return session.written(df, tag)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def utf8(name: str = "text"):
    """The UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def coded_id(name: str):
    """An id as text that may stand in a file's or a record's name; null is the one without a sign in front."""
    return F.coalesce(F.concat(F.lit("="), F.url_encode(F.col(name).cast("string"))), F.lit("null"))


def decoded_id(coded, kind):
    """The id of coded_id(), of the type that it had."""
    return F.when(F.startswith(coded, F.lit("=")), F.url_decode(F.substr(coded, F.lit(2)))).cast(kind)


def text_bytes(docs: DataFrame, name: str) -> int:
    """Bytes of a text column: one scan of it, without Python."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{name}`").cast("binary")).cast("long"))).first()[0] or 0


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node, over undirected edges (a, b) of comparable values.

    Alternating large-star and small-star steps; each round is a table in the shared folder, and so are the minima that its
    joins read: both sides of a join are then exchanges, whose hot nodes adaptive execution splits. It ends once every node
    has one edge and no root has any. Returns (node, root) for every node of an edge; a null in an edge drops it.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
        least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        edges = written(small.where("a <> b").distinct(), "edges")
        roots = edges.select(F.col("b").alias("a")).distinct()
        if edges.groupBy("a").count().where("count > 1").isEmpty() and edges.join(roots, "a", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
