"""Sorted 64-bit keys with small values, packed for a shuffle.

A chunk of documents sends each bucket of the key space one row: its distinct keys there, sorted, as gaps whose
byte planes compress, and their values. A bucket answers each chunk with one value per key in the order sent.
Rows number min(keys, chunks * buckets), never more than an exchange key by key.
"""

from __future__ import annotations

import numpy as np


def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(8, "little") + _zstd()[0].compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(_zstd()[1].decompress(raw[8:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    """Non-negative integers, any range."""
    wide = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _zstd()[0].compress(wide.tobytes())


def unpack_values(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(_zstd()[1].decompress(raw[8:]), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)


def split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of the key space starts among sorted keys, with the end."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
