"""Files in a shared folder, and arrays of numbers in few bytes."""

from __future__ import annotations

import numpy as np
import zstandard

from ..sources.blocks import get_batch, opened, put, put_batch

__all__ = ["get_batch", "opened", "put", "put_batch", "squeezed", "squeezed_sorted", "unsqueezed", "unsqueezed_sorted"]


def squeezed(values: np.ndarray) -> bytes:
    """An array of numbers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def squeezed_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers by their differences."""
    return squeezed(np.diff(values, prepend=np.uint64(0)).astype("<u8"))


def unsqueezed_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data, "<u8"), dtype=np.uint64)
