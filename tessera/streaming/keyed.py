"""Keyed tables over streams: Spark's state store holds each key's last or merged value, and each micro-batch appends what it changed.

A table lives under a path: the stream's checkpoint, the changes of each batch, and every COMPACT batches the whole table as it then
was. A batch costs what it changes; a batch that is run again writes the same folder. A stream started again on the same path goes
on where it stopped. The state store is the session's: RocksDB keeps a state that outgrows memory (session() asks for it).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.blocks import opened

#: Batches of changes after which the whole table is written.
COMPACT = 16


class Changes:
    """Rows (key, value, there) by batch; a key's last batch counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{schema}, there boolean"

    def folders(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that are whole."""
        fs, base = opened(self.path)
        some = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        found = [int(m[1]) for f in some if (m := re.fullmatch(rf"{kind}=(\d+)", f.base_name))]
        return sorted(n for n in found if fs.get_file_info(f"{base}/{kind}={n}/_SUCCESS").type == pafs.FileType.File)

    def read(self) -> DataFrame:
        """(key, value, there) of all keys, those that are gone included."""
        bases = self.folders("upto")
        since = bases[-1] if bases else -1
        parts = [("upto", since)] * bool(bases) + [("batch", n) for n in self.folders("batch") if n > since]
        out = None
        for kind, n in parts:  # one base and at most COMPACT batches or so
            one = self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}={n}").withColumn("_n", F.lit(n))
            out = one if out is None else out.union(one)
        if out is None:
            return self.spark.createDataFrame([], self.schema)
        last = F.max_by(F.struct("value", "there"), "_n")
        return out.groupBy("key").agg(last.alias("l")).select("key", "l.value", "l.there")

    def write(self, rows: DataFrame, n: int) -> None:
        rows.select("key", "value", "there").write.mode("overwrite").parquet(f"{self.path}/batch={n}")
        bases = self.folders("upto")
        if n - (bases[-1] if bases else -1) >= COMPACT:
            self.read().where("there").write.mode("overwrite").parquet(f"{self.path}/upto={n}")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Runs all that the stream has now, batch by batch."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def _kept(changes: DataFrame, schema: str, path: str | None, tag: str) -> DataFrame:
    spark = changes.sparkSession
    path = path or shared_path(spark, tag)
    table = Changes(spark, path, schema)
    run(changes, table.write, f"{path}/checkpoint")
    return table.read().where("there").select("key", "value")


def upserts(stream: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    """The state (key, value) after a stream of operations (key, op, value, order); order is comparable and unique for a key.

    Operations may come out of order, within batches and across: a key's state keeps its last order, deletions included. With a
    path the table stays there, and the next call with it goes on from there.
    """
    last = F.max_by(F.struct("op", "value"), "order")
    changes = stream.groupBy("key").agg(last.alias("l")).select("key", "l.value", (F.col("l.op") == 1).alias("there"))
    return _kept(changes, schema, path, "upserts")


def merges(stream: DataFrame, key: str, merged: Column, schema: str, path: str | None = None) -> DataFrame:
    """(key, value) after a stream of values under an aggregate. With a path the table stays there, and the next call goes on."""
    changes = stream.groupBy(F.col(key).alias("key")).agg(merged.alias("value")).withColumn("there", F.lit(True))
    return _kept(changes, schema, path, "merges")
