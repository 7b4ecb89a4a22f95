"""Media columns: texts as 8-bit greyscale PNG members of ZIP archives, read back by byte ranges with features."""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .common import coded_id, decoded_id, shared_path, sliced, utf8
from .files import FilesWriter, Range, ranges
from .store import opened

WIDTH = 64
SPLIT = 32 << 20
BATCH = 8 << 20
#: Times that a member is tried, each time with a handle of its own.
TRIES = 3
#: Bytes of a member's name without its suffix.
LONGEST = 65_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "member string, n_bytes long, payload binary, media binary, feature string"
ARROW = pa.schema([("member", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("feature", pa.string())])


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(data: bytes) -> bytes:
    """A PNG of WIDTH samples a row: the bytes of data, then zeros up to a positive multiple of WIDTH; a text chunk has len(data)."""
    rows = max(1, -(-len(data) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each row after its filter, none
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    lines[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % len(data)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def decoded(media: bytes) -> tuple[np.ndarray, int]:
    """(samples by row, unpadded length) of such a PNG. Raises ValueError if it is damaged or of another kind."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, parts, size, shape = 8, [], None, None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            size = int(data[8:])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    samples = lines[:, 1:]
    return samples, samples.size if size is None else size


def feature(samples: np.ndarray) -> str:
    """Rows, mean in thousandths, a histogram of 8 ranges of samples, and a difference hash of 64 column bands by halves."""
    counts = np.bincount(samples.reshape(-1) >> 5, minlength=8)
    total = int(samples.sum(dtype=np.int64))
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = int(np.packbits(columns > np.roll(columns, 1)).view(">u8")[0]) if samples.shape[1] == 64 else 0
    return f"rows={samples.shape[0]};mean={total * 1000 // samples.size};hist={','.join(map(str, counts.tolist()))};dhash={bits:016x}"


class MediaSource(DataSource):
    """Format "media_archive". Options: path (a folder of ZIP archives), splitBytes."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MediaReader(self.options["path"], int(self.options.get("splitbytes", SPLIT)))

    def writer(self, schema, overwrite):
        return MediaWriter(self.options["path"])


class MediaWriter(FilesWriter):
    suffix = ".zip"

    def fill(self, out, batches):
        rows = 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for b in sliced(batches):
                rows += b.num_rows
                for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if len(key) > LONGEST:
                        raise ValueError("an id is too long for a member's name")
                    archive.writestr(zipfile.ZipInfo(f"{key}.png"), encoded(data or b""))
        return rows


def fetched(fs, path: str, offset: int, size: int, crc: int, tries: int = TRIES, wait: float = 0.1) -> bytes:
    """The bytes of a stored member, by its offset alone. A failure is tried again without regard to other members."""
    for left in range(tries - 1, -1, -1):
        try:
            with fs.open_input_file(path) as src:
                src.seek(offset)
                head = src.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member at the offset")
                name, extra = struct.unpack("<HH", head[26:30])
                src.seek(offset + 30 + name + extra)
                data = src.read(size)
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError("a member is damaged")
            return data
        except (OSError, ValueError):
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


class MediaReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        return ranges(self.path, ".zip", self.split) or [Range("", 0, 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        fs, base = opened(self.path)
        path = f"{base}/{partition.name}"
        with fs.open_input_file(path) as src, zipfile.ZipFile(src) as archive:
            members = [(m.filename, m.header_offset, m.file_size, m.CRC) for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        held, size = [], 0
        for name, offset, n, crc in members:
            media = fetched(fs, path, offset, n, crc)
            samples, length = decoded(media)
            held.append((name.removesuffix(".png"), length, samples.tobytes(), media, feature(samples)))
            size += samples.size + len(media)
            if size >= BATCH:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    spark.dataSource.register(MediaSource)
    docs.select(coded_id(id_col).alias("member"), utf8(text_col).alias("data")).write.format("media_archive").mode("append").option("path", path).save()


def read_media(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("path", path).option("splitBytes", str(split)).load()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """(id, n_bytes, payload, media, feature) of every row's whole text, stored as a media member and read back.

    Null text: empty, so one row of zeros. Null id: a member of its own name, read back as null. Ids
    of any text: members' names are their percent-encoded form; ValueError if that is over 65,000 bytes, which the format can't hold. Repeated rows: a member each. Very
    long texts: a taller picture. Equal texts give equal columns. Other columns are not read. Empty table: no rows.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "media")
    write_media(docs, path, id_col, text_col)
    got = read_media(spark, path, split)
    key = decoded_id(F.col("member"), docs.schema[id_col].dataType)
    return got.select(key.alias("id"), "n_bytes", "payload", "media", "feature")
