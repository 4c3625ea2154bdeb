"""Arrays of 8-byte values as bytes, for rows that carry a block's sorted keys to their owners."""

from __future__ import annotations

import numpy as np
import zstandard

_squeeze, _restore = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """8-byte values by byte plane, compressed; sorted ones as differences."""
    values = np.ascontiguousarray(values, "<u8" if values.dtype != np.float64 else "<f8")
    if sorted_ and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return _squeeze.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes, sorted_: bool = False, kind: str = "<u8") -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(_restore.decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=np.uint64) if sorted_ else values


def slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's sorted keys begin, and the end."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.arange(1, buckets, dtype=np.uint64) << shift
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
