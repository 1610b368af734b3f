"""Filters of a fixed number of bits, whatever the number of keys: they may pass others, but drop none of the keys.

What passes is joined exactly afterwards; the filter only spares a shuffle the rows that surely meet nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for Python workers, and the parts in which it is put together.
FILTER_BITS, FILTER_SLICES = 1 << 26, 64
#: The filter for expressions: BITMAPS rows of Spark's 4096-byte bitmaps.
BITMAPS, BITMAP_BITS = 2048, 32768
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _places(keys: np.ndarray) -> np.ndarray:
    """Two bits for each key."""
    h = (keys ^ (keys >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    return np.stack((h >> np.uint64(38), (h * _MIX) >> np.uint64(38))).astype(np.int64)


def _slice_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = FILTER_BITS // FILTER_SLICES
    for b in batches:
        at = np.unique(_places(b["key"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        edges = np.searchsorted(at, np.arange(FILTER_SLICES + 1) * width)
        rows = [(k, (at[x:y] - k * width).astype("<u4").tobytes()) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "at"])


def _join_slices(group: pa.Table) -> pa.Table:
    bits = np.zeros(FILTER_BITS // FILTER_SLICES, bool)
    for raw in group["at"].to_pylist():
        bits[np.frombuffer(raw, "<u4")] = True
    return pa.table({"slice": group["slice"].slice(0, 1), "at": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def key_filter(keys: DataFrame):
    """A broadcast filter for Python workers of the longs in column key."""
    slices = keys.select("key").mapInArrow(_slice_keys, "slice int, at binary").groupBy("slice").applyInArrow(_join_slices, "slice int, at binary")
    bits = bytearray(FILTER_BITS // 8)
    step = FILTER_BITS // 8 // FILTER_SLICES
    for r in slices.collect():  # FILTER_BITS bits in all
        bits[r["slice"] * step : (r["slice"] + 1) * step] = r["at"]
    return keys.sparkSession.sparkContext.broadcast(bytes(bits))


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """bits: the broadcast value as uint8; keys: uint64."""
    a, b = _places(keys)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1) == 1


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one, that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def among(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with the boolean `name`: whether key, a long, may be in keys' column key; false is certain. Expressions alone."""
    place = lambda k: F.pmod(F.xxhash64(F.lit(9), k), F.lit(BITMAPS * BITMAP_BITS))
    row, bit = (lambda k: F.floor(place(k) / BITMAP_BITS).cast("int")), (lambda k: (place(k) % BITMAP_BITS).cast("long"))
    at, bits = (free_name(rows, x) for x in ("m_row", "m_bits"))
    bitmap = keys.groupBy(row(F.col("key")).alias(at)).agg(F.bitmap_construct_agg(bit(F.col("key"))).alias(bits))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(bit(key) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("shiftright", byte, (bit(key) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return rows.withColumn(at, row(key)).join(F.broadcast(bitmap), at, "left").withColumn(name, held).drop(at, bits)


def without(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows whose key, a long, is not in keys' column key; rows with a null key stay. Only rows that pass the filter are shuffled."""
    mark, own, other = (free_name(rows, x) for x in ("m_maybe", "m_key", "m_other"))
    marked = among(rows, key, keys, mark).withColumn(own, key)
    names = [F.col(f"`{c}`") for c in rows.columns]
    sure = marked.filter(~F.col(mark)).select(*names)
    held = marked.filter(mark).join(keys.select(F.col("key").alias(other)), F.col(own) == F.col(other), "left_anti")
    return sure.unionByName(held.select(*names))
