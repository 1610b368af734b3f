"""Colour projections as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the XYB colour space.
MIX = ((0.30, 0.622, 0.078), (0.23, 0.692, 0.078))
S_BETA, S_RHO = 0.55180986, 0.24342269 / (0.24342269 + 0.20476745)
BIAS, BIAS_CBRT = 0.0037930734, 0.1559542
UNMIX = ((11.031567, -9.866944, -0.16462299), (-3.2541473, 4.4187703, -0.16462299), (-3.6588514, 2.712923, 1.9459282))
LATTICE = (4096, 512, 256)
# Chromaticities of red, green, blue and D65.
PRIMARIES = {
    "srgb": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)),
    "p3": ((0.68, 0.32), (0.265, 0.69), (0.15, 0.06)),
    "bt2020": ((0.708, 0.292), (0.17, 0.797), (0.131, 0.046)),
}
D65 = (0.3127, 0.3290)


def srgb_to_linear(v: Column) -> Column:
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_linear(name: str, v: Column) -> Column:
    """Transfer functions to linear light by name."""
    if name == "pq":
        m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128
        p = F.pow(v, F.lit(1 / m2))
        return F.pow(F.greatest(p - c1, F.lit(0.0)) / (F.lit(c2) - p * c3), F.lit(1 / m1)) * (10000 / 255)
    if name == "hlg":
        return F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - 0.5599107) / 0.17883277) + 0.28466892) / 12)
    if name == "bt709":
        a, b = 1.0992968, 0.01805397
        return F.when(v < 4.5 * b, v / 4.5).otherwise(F.pow((v + (a - 1)) / a, F.lit(1 / 0.45)))
    if name == "smpte240":
        return F.when(v < 0.0912, v / 4).otherwise(F.pow((v + 0.1115) / 1.1115, F.lit(1 / 0.45)))
    if name in (powers := {"bt470m": 2.2, "bt470bg": 2.8, "smpte428": 2.6}):
        return F.pow(v, F.lit(powers[name]))
    if name == "linear":
        return v
    raise ValueError(f"no transfer function {name}")


def _to_xyz(primaries: tuple, white: tuple) -> np.ndarray:
    columns = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in primaries]).T
    x, y = white
    return columns * np.linalg.solve(columns, np.array([x / y, 1.0, (1 - x - y) / y]))


def to_srgb_matrix(primaries: str) -> np.ndarray:
    return np.linalg.solve(_to_xyz(PRIMARIES["srgb"], D65), _to_xyz(PRIMARIES[primaries], D65))


def apply_matrix(m, c: list[Column]) -> list[Column]:
    return [c[0] * float(r[0]) + c[1] * float(r[1]) + c[2] * float(r[2]) for r in m]


def xyb(r: Column, g: Column, b: Column) -> list[Column]:
    """X, Y, B of linear RGB."""
    s = (S_RHO * (1 - S_BETA), (1 - S_RHO) * (1 - S_BETA), S_BETA)
    l_, m_, s_ = (F.cbrt(F.greatest(c + BIAS, F.lit(0.0))) - BIAS_CBRT for c in apply_matrix((*MIX, s), [r, g, b]))
    return [(l_ - m_) * 0.5, (l_ + m_) * 0.5, s_]


def xyb_to_rgb(x: Column, y: Column, b: Column) -> list[Column]:
    cubes = [F.pow(v + BIAS_CBRT, F.lit(3.0)) - BIAS for v in (y + x, y - x, b)]
    return apply_matrix(UNMIX, cubes)


def xyb_lattice(x: Column, y: Column, b: Column) -> list[Column]:
    """Integers: scaled X and Y, and what B has beyond Y."""
    yq = F.round(y * LATTICE[1]).cast("long")
    return [F.round(x * LATTICE[0]).cast("long"), yq, F.round(b * LATTICE[2]).cast("long") - yq]


def ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    y = r * 0.299 + g * 0.587 + b * 0.114
    return [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]


def half(a: Column) -> Column:
    """Floor of a half, for negative numbers too."""
    return F.shiftright(a, 1)


def ycocg(r: Column, g: Column, b: Column) -> list[Column]:
    """Reversible Y, Co, Cg."""
    co = r - b
    t = b + half(co)
    cg = g - t
    return [t + half(cg), co, cg]


def ycocg_inverse(y: Column, co: Column, cg: Column) -> list[Column]:
    t = y - half(cg)
    g = cg + t
    b = t - half(co)
    return [b + co, g, b]


def rct(kind: int, c: list[Column]) -> list[Column]:
    """The reversible transform `kind` of 42: six orders of the channels by seven steps."""
    p, step = divmod(kind, 7)
    a, b, d = c[p % 3], c[(p + 1 + p // 3) % 3], c[(p + 2 - p // 3) % 3]
    if step == 6:
        return ycocg(a, b, d)
    third = d - a if step % 2 else d
    second = {0: b, 1: b - a, 2: b - half(a + d)}[step // 2]
    return [a, second, third]


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 299 + g * 587 + b * 114


def blend(over: Column, under: Column, coverage: Column) -> Column:
    """Eight-bit compositing, rounded."""
    return F.floor((over * coverage + under * (F.lit(255) - coverage) + 127) / 255).cast("long")


def distance_from_quality(q: Column) -> Column:
    d = F.when(q >= 99, F.pow(F.lit(2.0), 100 - q) * 0.05).when(q >= 90, F.pow(F.lit(10.0), (99 - q) / 9 - 1)).when(q >= 30, (100 - q) * 0.09 + 0.1)
    return F.least(d.otherwise(F.pow(F.lit(2.5), (30 - q) / 5) / 6.25 + 6.24), F.lit(25.0))


def jpeg_quality(d: Column) -> Column:
    q = F.when(d <= 0.05, 100.0).when(d <= 0.1, F.lit(100) - F.log2(d / 0.05)).when(d <= 1, F.lit(99) - (F.log10(d) + 1) * 9).when(d <= 6.4, F.lit(100) - (d - 0.1) / 0.09)
    return F.least(F.greatest(F.round(q.otherwise(F.lit(30) - F.log((d - 6.24) * 6.25) * (5 / np.log(2.5)))), F.lit(1.0)), F.lit(100.0)).cast("long")


def avif_quality(d: Column) -> Column:
    return F.least(F.greatest(F.round(F.lit(100) - d * 10), F.lit(1.0)), F.lit(100.0)).cast("long")


def piecewise(x: Column, knots: list[float], values: list[float]) -> Column:
    """Linear between knots, constant beyond them."""
    out = F.when(x <= knots[0], F.lit(values[0]))
    for a, b, u, v in zip(knots, knots[1:], values, values[1:], strict=False):
        out = out.when(x <= b, F.lit(u) + (x - a) * ((v - u) / (b - a)))
    return out.otherwise(F.lit(values[-1]))


def nearest_multiple(v: Column, error: int, most: int) -> Column:
    """The nearest multiple of 2 * error + 1, `most` at most."""
    step = 2 * error + 1
    return F.least(F.floor((v + error) / step) * step, F.lit(most)).cast("long")


def signed_multiple(v: Column, k: int) -> Column:
    """The nearest multiple of k, halves away from zero."""
    return (F.signum(v) * F.floor((F.abs(v) + k // 2) / k) * k).cast("long")


def color_key(c: list[Column]) -> Column:
    """Three 21-bit fields, each biased to be positive, in one number."""
    bias = 1 << 20
    return (c[0] + bias) * (1 << 42) + (c[1] + bias) * (1 << 21) + (c[2] + bias)


def key_color(key: Column) -> list[Column]:
    bias, mask = 1 << 20, F.lit((1 << 21) - 1)
    return [F.shiftright(key, 42).bitwiseAND(mask) - bias, F.shiftright(key, 21).bitwiseAND(mask) - bias, key.bitwiseAND(mask) - bias]
