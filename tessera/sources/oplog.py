"""The binary operation log as a data source: bucket files of records (op, key length, value length, key, value)."""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.hashing import bucket_of

# Fixed values of the format.
HEADER = struct.Struct("<BII")
SET, DELETE = 1, 2
SCHEMA = "bucket int, seq long, op int, key string, value string"


def record(op: int, key: bytes, value: bytes) -> bytes:
    if max(len(key), len(value)) > 0xFFFFFFFF:
        raise ValueError("a key or value is too long")
    return HEADER.pack(op, len(key), len(value)) + key + value


def records(src) -> Iterator[tuple[int, str, str]]:
    """(op, key, value) of a stream. Raises EOFError on a record that is cut off, ValueError on an unknown operation."""
    while head := src.read(HEADER.size):
        if len(head) < HEADER.size:
            raise EOFError("a header is cut off")
        op, k, v = HEADER.unpack(head)
        body = src.read(k + v)
        if len(body) < k + v:
            raise EOFError("a record is cut off")
        if op not in (SET, DELETE):
            raise ValueError(f"unknown operation {op}")
        yield op, body[:k].decode(), body[k:].decode()


def _opened(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


#: Bytes after which a bucket goes on in another file: files are read by tasks of their own.
ROLL = 64 << 20


@dataclass
class Part(InputPartition):
    """A file of a bucket, and how many records stand before it."""

    bucket: int
    name: str
    before: int


@dataclass
class Done(WriterCommitMessage):
    names: list


class OplogSource(DataSource):
    """Format "oplog". Options: path, buckets (kept with the table; another number is refused)."""

    @classmethod
    def name(cls):
        return "oplog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return OplogReader(self.options["path"])

    def writer(self, schema, overwrite):
        return OplogWriter(self.options["path"], int(self.options["buckets"]), overwrite)


def _manifest(fs, base: str) -> dict:
    try:
        with fs.open_input_stream(f"{base}/_table.json", compression=None) as src:
            return json.loads(src.read())
    except FileNotFoundError:
        return {}


ARROW = pa.schema([("bucket", pa.int32()), ("seq", pa.int64()), ("op", pa.int32()), ("key", pa.string()), ("value", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class OplogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        fs, base = _opened(self.path)
        out = []
        for bucket, files in _manifest(fs, base).get("files", {}).items():
            before = 0
            for name, count in files:
                out.append(Part(int(bucket), name, before))
                before += count
        return out or [Part(0, "", 0)]

    def read(self, partition):
        if not partition.name:
            return
        fs, base = _opened(self.path)
        at, held = partition.before, []
        with fs.open_input_stream(f"{base}/{partition.name}", compression=None) as src:
            for op, k, v in records(src):
                held.append((partition.bucket, at, op, k, v))
                at += 1
                if len(held) >= 4096:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)


class OplogWriter(DataSourceArrowWriter):
    """Rows (bucket, op, key, value) in order; a task writes a file for each bucket that it has, and another once one holds ROLL bytes.
    Files count once committed, in the order of tasks. The format has no null: a delete's value is empty, and a null key or a null
    value that is set raises ValueError."""

    def __init__(self, path: str, buckets: int, overwrite: bool):
        self.path, self.buckets, self.overwrite = path, buckets, overwrite
        fs, base = _opened(path)
        had = _manifest(fs, base).get("buckets")
        if had not in (None, buckets):
            raise ValueError(f"the table has {had} buckets, not {buckets}")

    def write(self, iterator):
        fs, base = _opened(self.path)
        fs.create_dir(base, recursive=True)
        names, out, now, size = [], None, None, 0
        for b in iterator:
            for bucket, op, key, value in zip(*(b.column(k).to_pylist() for k in ("bucket", "op", "key", "value"))):
                if key is None or value is None and op == SET:
                    raise ValueError("a key or value that is null can't be kept")
                if out is None or bucket != now or size >= ROLL:
                    if out is not None:
                        out.close()
                    now, size = bucket, 0
                    names.append([now, f"bucket_{now}-{uuid.uuid4().hex}.dat", 0])
                    out = fs.open_output_stream(f"{base}/{names[-1][1]}", compression=None)
                data = record(op, key.encode(), (value or "").encode())
                out.write(data)
                size += len(data)
                names[-1][2] += 1
        if out is not None:
            out.close()
        return Done(names)

    def commit(self, messages):
        fs, base = _opened(self.path)
        fs.create_dir(base, recursive=True)
        files = {} if self.overwrite else _manifest(fs, base).get("files", {})
        for m in messages:  # in the order of tasks
            for bucket, name, count in m.names if m else []:
                files.setdefault(str(bucket), []).append((name, count))
        other = f"{base}/_table.json.{uuid.uuid4().hex}"
        with fs.open_output_stream(other, compression=None) as out:
            out.write(json.dumps({"buckets": self.buckets, "files": files}).encode())
        fs.move(other, f"{base}/_table.json")

    def abort(self, messages):
        fs, base = _opened(self.path)
        for m in messages:
            for _, name, _ in m.names if m else []:
                fs.delete_file(f"{base}/{name}")


def append(log: DataFrame, path: str, buckets: int, mode: str = "append") -> None:
    """Writes (seq, op, key, value) to their buckets, in the order of seq. Tasks take ranges of bucket and seq, so that the bucket of
    a hot key is written by several. Null keys raise, as null values that are set do."""
    log.sparkSession.dataSource.register(OplogSource)
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = log.withColumn("bucket", F.coalesce(bucket_of(F.col("key"), buckets), F.lit(0)))
    rows = numbered.repartitionByRange(parts, "bucket", "seq").sortWithinPartitions("bucket", "seq")
    rows.select("bucket", "seq", F.col("op").cast("int").alias("op"), "key", "value").write.format("oplog").mode(mode).option("path", path).option("buckets", str(buckets)).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, seq, op, key, value); seq counts within a bucket."""
    spark.dataSource.register(OplogSource)
    return spark.read.format("oplog").option("path", path).load()


def clear(spark: SparkSession, path: str, buckets: int) -> None:
    """The log without its records."""
    append(spark.createDataFrame([], "seq long, op int, key string, value string"), path, buckets, "overwrite")


def compacted(log: DataFrame) -> DataFrame:
    """The log with only the last set of each key that is live, in the old order."""
    last = F.max_by(F.struct("op", "value", "seq"), "seq")
    return log.groupBy("bucket", "key").agg(last.alias("l")).where(F.col("l.op") == SET).select("bucket", F.col("l.seq").alias("seq"), F.col("l.op").alias("op"), "key", F.col("l.value").alias("value"))
