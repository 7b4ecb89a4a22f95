"""What the file formats share: a writer that commits a list of files, and ranges of bytes planned from it."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

from .store import opened, put

MANIFEST = "_files.json"


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int
    size: int


class FilesWriter(DataSourceArrowWriter):
    """A file for each task, under a name of its own; only files of committed tasks are in the manifest, so that retried or
    speculative attempts leave nothing that is read."""

    suffix = ""

    def __init__(self, path: str):
        self.path = path

    def fill(self, out, batches) -> int:
        """Writes all rows and returns how many there were."""
        raise NotImplementedError

    def write(self, iterator):
        fs, base = opened(self.path)
        name = uuid.uuid4().hex + self.suffix
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            rows = self.fill(out, iterator)
            size = out.tell()
        if not rows:
            fs.delete_file(f"{base}/{name}")
        return Written(name, size if rows else 0)

    def commit(self, messages):
        files = sorted((m.name, m.size) for m in messages if m is not None and m.size)
        put(f"{self.path}/{MANIFEST}", lambda out: out.write(json.dumps(files).encode()))

    def abort(self, messages):
        fs, base = opened(self.path)
        for m in messages:
            if m is not None and m.size:
                fs.delete_file(f"{base}/{m.name}")


def ranges(path: str, suffix: str, split: int) -> list[Range]:
    """Byte ranges of at most split bytes over a folder's files: those of the manifest, or all of the suffix without one."""
    fs, base = opened(path)
    try:
        with fs.open_input_stream(f"{base}/{MANIFEST}") as src:
            files = json.loads(src.read())
    except FileNotFoundError:
        import pyarrow.fs as pafs

        files = sorted((f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(suffix))
    return [Range(name, at, min(at + split, size), size) for name, size in files for at in range(0, size, split)]
