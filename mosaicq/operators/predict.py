"""Causal neighbours, predictors and tree properties of raster samples (img, c, i, x, y, v).

All taps of an image's channel come from one window in raster order: a tap k columns left and m rows up lies
k + m * width samples back, so one shuffle and one sort serve them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.functions.codes import clamped_gradient, hybrid_bits, hybrid_token, zigzag
from mosaicq.sources.planes import WIDTH

PLANE = ("img", "c")


def truncated(v: Column, k: int) -> Column:
    """Integer quotient toward zero."""
    return F.when(v >= 0, F.floor(v / k)).otherwise(-F.floor(-v / k)).cast("long")


def tap(dx: int, dy: int, value: str | Column = "v", by: tuple[str, ...] = PLANE, width: int = WIDTH) -> Column:
    """The sample dx to the right and dy below; null outside."""
    back = -(dx + dy * width)
    w = W.partitionBy(*by).orderBy("i")
    got = F.lag(value, back).over(w) if back >= 0 else F.lead(value, -back).over(w)
    if dx < 0:
        return F.when(F.col("x") >= -dx, got)
    return F.when(F.col("x") < width - dx, got) if dx else got


def neighbours(px: DataFrame) -> DataFrame:
    """px with w, n, nw, ne, ww, nn, nee; what lies outside falls back on a nearer neighbour, in the end on 0."""
    raw = px.select("*", *[tap(dx, dy).alias(f"t_{n}") for n, dx, dy in (("w", -1, 0), ("n", 0, -1), ("nw", -1, -1), ("ne", 1, -1), ("ww", -2, 0), ("nn", 0, -2), ("nee", 2, -1))])
    out = raw.withColumn("w", F.coalesce("t_w", "t_n", F.lit(0))).withColumn("n", F.coalesce("t_n", "w")).withColumn("ne", F.coalesce("t_ne", "n"))
    out = out.withColumns({"nw": F.coalesce("t_nw", "w"), "ww": F.coalesce("t_ww", "w"), "nn": F.coalesce("t_nn", "n"), "nee": F.coalesce("t_nee", "ne")})
    return out.drop(*[f"t_{n}" for n in ("w", "n", "nw", "ne", "ww", "nn", "nee")])


def predictors() -> dict[int, Column]:
    """The predictors without memory, by number; averages truncate toward zero."""
    w, n, nw, ne, ww, nn, nee = (F.col(c) for c in ("w", "n", "nw", "ne", "ww", "nn", "nee"))
    mean = lambda a, b: truncated(a + b, 2)
    return {
        0: F.lit(0).cast("long"), 1: w, 2: n, 3: mean(w, n), 4: F.when(F.abs(n - nw) < F.abs(w - nw), w).otherwise(n),
        5: clamped_gradient(w, n, nw), 7: ne, 8: nw, 9: ww, 10: mean(w, nw), 11: mean(nw, n), 12: mean(n, ne),
        13: truncated(n * 6 - nn * 2 + w * 7 + ww + nee + ne * 3 + 8, 16),
    }


def properties() -> dict[int, Column]:
    """The properties 0 to 14 that a decision tree may test; 8 needs the pixel before."""
    w, n, nw, ne, ww, nn = (F.col(c) for c in ("w", "n", "nw", "ne", "ww", "nn"))
    nine = w + n - nw
    before = F.coalesce(tap(-1, 0, nine_column()), F.lit(0))
    return {
        0: F.col("c").cast("long"), 1: F.lit(0).cast("long"), 2: F.col("y"), 3: F.col("x"), 4: F.abs(n), 5: F.abs(w), 6: n, 7: w, 8: w - before,
        9: nine, 10: w - nw, 11: nw - n, 12: n - ne, 13: n - nn, 14: w - ww,
    }


def nine_column() -> Column:
    return F.col("w") + F.col("n") - F.col("nw")


def residual_tokens(px: DataFrame, prediction: Column | None = None, *keep: str) -> DataFrame:
    """(img, c, i, x, y, keep, e, z, token, nbits): what the prediction leaves, zigzagged, as a hybrid integer."""
    e = F.col("v") - (clamped_gradient(F.col("w"), F.col("n"), F.col("nw")) if prediction is None else prediction)
    out = neighbours(px).select("img", "c", "i", "x", "y", *keep, e.alias("e")).withColumn("z", zigzag(F.col("e")))
    return out.withColumns({"token": hybrid_token(F.col("z")), "nbits": hybrid_bits(F.col("z"))})
