"""Record batches as files of the shared folder, opened by URI (file:, hdfs:, s3: and whatever else pyarrow.fs knows)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, write) -> None:
    """Writes a file under another name and moves it to its place, so that nobody reads half of it."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    other = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(other, compression=None) as out:
        write(out)
    try:
        fs.move(other, path)
    except OSError:  # some stores don't move over what an earlier attempt has left
        fs.delete_file(path)
        fs.move(other, path)


def put_batch(uri: str, batch: pa.RecordBatch, compression: str | None = "zstd") -> None:
    def write(out):
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as w:
            w.write_batch(batch)

    put(uri, write)


def get_batch(uri: str) -> pa.RecordBatch:
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as src, pa.ipc.open_stream(src) as r:
        return next(iter(r))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most rows rows and about size bytes, a single row aside: what is worked on at once doesn't depend on
    the session's settings. Cuts copy nothing."""
    for whole in batches:
        left = [whole.slice(k, rows) for k in range(0, whole.num_rows, rows)][::-1]
        while left:
            b = left.pop()
            if b.num_rows > 1 and b.nbytes > size:
                half = b.num_rows // 2
                left += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def joined(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold size bytes."""
    held, now = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            now += b.nbytes
        if now >= size:
            yield one(held)
            held, now = [], 0
    if held:
        yield one(held)


def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=1 << 40)[0]
