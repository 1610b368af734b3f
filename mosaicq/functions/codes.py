"""Integer codes as column expressions: zigzag, hybrid integers, lengths in bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def floor_log2(v: Column) -> Column:
    """Exact for positive integers."""
    return (F.length(F.bin(v)) - 1).cast("long")


def hybrid_token(v: Column, split: int = 4, msb: int = 2, lsb: int = 0) -> Column:
    """The token of a hybrid integer: values below 2**split stand for themselves, larger ones give their magnitude and
    the msb bits that follow its first and its lsb last."""
    n = floor_log2(v)
    top = F.call_function("shiftright", v - F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")), (n - msb).cast("int"))
    low = v.bitwiseAND(F.lit((1 << lsb) - 1))
    big = F.lit(1 << split) + (n - split) * (1 << (msb + lsb)) + top * (1 << lsb) + low
    return F.when(v < (1 << split), v).otherwise(big)


def hybrid_bits(v: Column, split: int = 4, msb: int = 2, lsb: int = 0) -> Column:
    return F.when(v < (1 << split), F.lit(0)).otherwise(floor_log2(v) - msb - lsb).cast("long")


def varint_bytes(v: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((floor_log2(F.greatest(v, F.lit(1))) + 1) / 7)).cast("long")


def clamped_gradient(w: Column, n: Column, nw: Column) -> Column:
    return F.least(F.greatest(w + n - nw, F.least(w, n)), F.greatest(w, n))
