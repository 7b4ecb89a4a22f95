"""WARC files of gzip members, and a splittable reader: tasks scan byte ranges for members and own those that start inside."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .common import coded_id, decoded_id, shared_path, sliced, written
from .files import FilesWriter, Range, ranges
from .store import opened

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Bytes that one task reads, and payload bytes of a batch.
SPLIT = 32 << 20
BATCH = 8 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def record(key: str, uri: str | None, payload: bytes | None, size: int, digest: str, refers: str | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone. digest: hex SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"") if refers is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{key}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parsed(data: bytes) -> dict:
    """A row of a whole record. Raises ValueError if it isn't one."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a record is cut off")
    body, http = rest[:size], b""
    if "application/http" in fields.get("content-type", ""):
        http, _, body = body.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "")
    named = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    if fields.get("warc-type") == "revisit":
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n, payload = int(said[1]) if said else None, None
    else:
        n, payload, got = len(body), body, hashlib.sha1(body).hexdigest()
        if named not in (None, got):
            raise ValueError("a payload doesn't match its digest")
        named = got
    bare = lambda x: x[1:-1] if x else None
    return {"record_id": bare(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "refers_to": bare(fields.get("warc-refers-to")), "payload_bytes": n, "payload_digest": named, "payload": payload}


def member(src, at: int) -> tuple[bytes, int]:
    """The contents of the gzip member at an offset, and where it ends. Raises zlib.error or ValueError."""
    src.seek(at)
    z, out, end = zlib.decompressobj(31), [], at
    while not z.eof:
        chunk = src.read(1 << 16)
        if not chunk:
            raise ValueError("a member is cut off")
        end += len(chunk)
        out.append(z.decompress(chunk))
        if out[0] and len(out) == 1 and not out[0].startswith(b"WARC/1."[: len(out[0])]):
            raise ValueError("no WARC header")
    return b"".join(out), end - len(z.unused_data)


def starts(src, start: int, end: int) -> Iterator[int]:
    """Offsets of gzip magic that begin in [start, end)."""
    at = start
    while at < end:
        src.seek(at)
        data = src.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        k = data.find(MAGIC)
        while k >= 0 and at + k < end:
            yield at + k
            k = data.find(MAGIC, k + 1)
        at += CHUNK


def records(src, start: int, end: int, size: int) -> Iterator[dict]:
    """Rows of the records whose members start in [start, end).

    Magic may also stand inside compressed data, so the first member is one that decodes to a WARC header and is followed by
    the file's end or by magic; from there members follow one another.
    """
    at = None
    for k in starts(src, start, end):
        try:
            data, after = member(src, k)
            row = parsed(data)
        except (ValueError, zlib.error, KeyError):
            continue
        src.seek(after)
        if after == size or src.read(len(MAGIC)) == MAGIC:
            yield row
            at = after
            break
    while at is not None and at < end and at < size:
        data, at = member(src, at)
        yield parsed(data)


class WarcSource(DataSource):
    """Format "warc". Options: path (a folder), splitBytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], int(self.options.get("splitbytes", SPLIT)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


class WarcWriter(FilesWriter):
    suffix = ".warc.gz"

    def fill(self, out, batches):
        rows = 0
        for b in sliced(batches):
            rows += b.num_rows
            for row in zip(*(b.column(k).to_pylist() for k in ("record_id", "uri", "payload", "payload_bytes", "payload_digest", "refers_to"))):
                out.write(record(*row))
        return rows


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        return ranges(self.path, ".warc.gz", self.split) or [Range("", 0, 0, 0)]

    def read(self, partition):
        if not partition.size:
            return
        fs, base = opened(self.path)
        held, size = [], 0
        with fs.open_input_file(f"{base}/{partition.name}") as src:
            for row in records(src, partition.start, partition.end, partition.size):
                held.append(row)
                size += len(row["payload"] or b"") + 300
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", least: int = 1000) -> None:
    """A record for each page, its text in UTF-8 as payload. Of equal payloads of least bytes or more only that of the largest
    id is written whole; the others are revisits that refer to it."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload")).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    many = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select(F.col("payload_digest").alias("digest"), "last")
    many = written(many, "repeated")
    # A bit for each first 24 bits of a repeated digest, at most 512 rows of 4 KB: pages whose bit is not set move nowhere.
    bit = lambda c: F.conv(F.substring(c, 1, 6), 16, 10).cast("long")
    maps = many.groupBy(F.shiftright(bit("digest"), 15).alias("_bucket")).agg(F.bitmap_construct_agg(bit("digest").bitwiseAND(F.lit(32767))).alias("_bits"))
    own = bit("payload_digest").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substr("_bits", (F.shiftright(own, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = rows.join(F.broadcast(maps), F.shiftright(bit("payload_digest"), 15) == F.col("_bucket"), "left")
    told = told.withColumn("_may", (F.col("payload_bytes") >= least) & F.coalesce(F.getbit(byte, F.pmod(own, F.lit(8)).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")
    alone = told.where("not _may").withColumn("last", F.lit(None).cast(rows.schema["id"].dataType))
    # Both sides are exchanges of their own, so that adaptive execution splits a payload that many pages share.
    shared = told.where("_may").join(many.repartition("digest"), F.col("payload_digest") == F.col("digest"), "left").drop("digest")
    joined = alone.unionByName(shared)
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    key = lambda c: F.concat(F.lit("urn:page:"), coded_id(c))
    slim = joined.select(key("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "uri", F.when(revisit, key("last")).alias("refers_to"), "payload_bytes", "payload_digest", F.when(~revisit, F.col("payload")).alias("payload"))
    spark.dataSource.register(WarcSource)
    slim.write.format("warc").mode("append").option("path", path).save()


def read_records(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Rows of all records of a folder's files, by byte ranges."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("splitBytes", str(split)).load()


def archived(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", least: int = 1000, split: int = SPLIT) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of pages as written to WARC files and read back.

    Null text: an empty payload. Null id: a record that revisits the largest id of an equal payload; without any, a response.
    Ids of any text: they stand percent-encoded in records' names. Repeated rows: those of the largest id are responses each.
    Null URL: no target. Very long payloads: a member each, read in pieces. Other columns are not read. Empty table: no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_pages(pages, path, id_col, uri_col, text_col, least)
    got = read_records(spark, path, split)
    kind = pages.schema[id_col].dataType
    bare = lambda c: decoded_id(F.replace(F.col(c), F.lit("urn:page:"), F.lit("")), kind)
    return got.select(bare("record_id").alias("id"), "payload_bytes", "payload_digest", "record_type", bare("refers_to").alias("refers_to"))
