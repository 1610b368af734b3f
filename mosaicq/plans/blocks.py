"""Queries of block transforms, quantisation and regressions over 8x8 blocks of embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.plans.catalog import query
from mosaicq.plans.sql import BLOCKS, LONG
from mosaicq.plans.windows import raw_channels
from mosaicq.sources import planes


def cosine(u: int, x: int, n: int = 8) -> float:
    """The DCT's basis, scaled so that the first coefficient is the mean."""
    return (1.0 if u == 0 else math.sqrt(2.0)) * math.cos((2 * x + 1) * u * math.pi / (2 * n)) / n


def wide_blocks(spark, sf):
    """(block, s): a block's 64 samples in one array."""
    return planes.table(spark, sf, "embeddings").select(F.col("vec_id").alias("block"), F.transform("embedding", lambda v: v.cast("double")).alias("s"))


def basis(n: int) -> np.ndarray:
    return np.array([[cosine(u, x, n) for x in range(n)] for u in range(n)])


def product(blocks, left: np.ndarray, right: np.ndarray):
    """(block, t): left @ S @ right.T for each block's array s of left's columns by right's, one product a batch; other lengths go."""
    rows, cols = left.shape[1], right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b["s"].flatten().to_numpy(zero_copy_only=False).reshape(-1, rows, cols)
            t = np.ascontiguousarray(left @ s @ right.T).reshape(-1)
            step = left.shape[0] * right.shape[0]
            ends = pa.array(np.arange(0, len(t) + 1, step, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b["block"], pa.ListArray.from_arrays(ends, pa.array(t))], ["block", "t"])

    whole = blocks.filter(F.size("s") == rows * cols).select(F.col("block").cast("long").alias("block"), "s")
    return whole.mapInArrow(run, "block long, t array<double>")


_DCT = f"{BLOCKS}, d AS (SELECT block, u + 8 * v AS k, sum(b.v * cx * cy) AS coef FROM (SELECT block, k % 8 AS x, k // 8 AS y, v FROM blk) b JOIN (SELECT u, x, CASE WHEN u = 0 THEN 1.0 ELSE sqrt(2.0) END * cos((2 * x + 1) * u * pi() / 16) / 8 AS cx FROM range(8) AS a(u), range(8) AS b(x)) USING (x) JOIN (SELECT v AS vv, y, CASE WHEN v = 0 THEN 1.0 ELSE sqrt(2.0) END * cos((2 * y + 1) * v * pi() / 16) / 8 AS cy FROM range(8) AS a(v), range(8) AS b(y)) AS q(v, y, cy) USING (y) GROUP BY block, u, q.v)".replace("SELECT block, u + 8 * v AS k", "SELECT block, u + 8 * q.v AS k")


def dct(spark, sf):
    coefs = product(wide_blocks(spark, sf), basis(8), basis(8))
    return coefs.select("block", F.posexplode("t").alias("k", "coef")).select("block", F.col("k").cast("long").alias("k"), "coef")


@query("trf01_dct8", f"WITH {_DCT} SELECT block, k, round(coef, 6) AS coef FROM d")
def _(spark, sf):
    return dct(spark, sf).withColumn("coef", F.round("coef", 6))


SHAPES = ((2, 2), (4, 4), (4, 8), (8, 4), (8, 8), (8, 16), (16, 8), (16, 16), (8, 32), (32, 8), (16, 32), (32, 16), (32, 32), (64, 32), (32, 64), (64, 64), (128, 64), (64, 128), (128, 128))


def _shape_sql(rows: int, cols: int) -> str:
    n = rows * cols
    if n <= 64:
        source = f"SELECT block * {64 // n} + k // {n} AS block, k % {n} AS p, v FROM blk"
    else:
        source = f"SELECT block // {n // 64} AS block, block % {n // 64} * 64 + k AS p, v FROM blk WHERE block // {n // 64} IN (SELECT block // {n // 64} FROM blk GROUP BY block // {n // 64} HAVING count(*) = {n})"
    wave = lambda u, x, m: f"CASE WHEN {u} = 0 THEN 1.0 ELSE sqrt(2.0) END * cos((2 * {x} + 1) * {u} * pi() / {2 * m}) / {m}"
    first = f"SELECT block, p // {cols} AS y, u, sum(v * ({wave('u', f'(p % {cols})', cols)})) AS g FROM ({source}), range({cols}) AS a(u) GROUP BY block, p // {cols}, u"
    return f"SELECT block, '{rows}x{cols}' AS shape, u + {cols} * w AS k, round(sum(g * ({wave('w', 'y', rows)})), 6) + 0.0 AS coef FROM ({first}), range({rows}) AS b(w) GROUP BY block, u, w"


def shaped(spark, sf, rows: int, cols: int):
    """(block, s) of any shape: parts of an embedding, or as many successive ones as it takes, where all of them are there."""
    n, wide = rows * cols, wide_blocks(spark, sf)
    if n == 64:
        return wide
    if n < 64:
        parts = F.transform(F.sequence(F.lit(0), F.lit(64 // n - 1)), lambda i: F.slice("s", i * n + 1, n))
        return wide.select("block", F.posexplode(parts).alias("i", "s")).select((F.col("block") * (64 // n) + F.col("i")).alias("block"), "s")
    grouped = wide.groupBy(F.expr(f"block div {n // 64}").alias("of")).agg(F.sort_array(F.collect_list(F.struct("block", "s"))).alias("p"))  # a shape's own few
    return grouped.filter(F.size("p") == n // 64).select(F.col("of").alias("block"), F.flatten("p.s").alias("s"))


@query("trf02_dct_family", f"WITH {BLOCKS} " + " UNION ALL ".join(_shape_sql(r, c) for r, c in SHAPES))
def _(spark, sf):
    """The transform in all its shapes."""
    out = [product(shaped(spark, sf, r, c), basis(r), basis(c)).select("block", F.lit(f"{r}x{c}").alias("shape"), F.posexplode("t").alias("k", "coef")) for r, c in SHAPES]
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every.select("block", "shape", F.col("k").cast("long").alias("k"), (F.round("coef", 6) + 0.0).alias("coef"))


@query("trf03_inverse_dct", f"WITH {BLOCKS} SELECT block, k, round(v, 5) + 0.0 AS v FROM blk")
def _(spark, sf):
    """There and back: the inverse sums the same basis, scaled by the number of samples."""
    t = product(wide_blocks(spark, sf), basis(8), basis(8)).select("block", F.col("t").alias("s"))
    back = product(t, 8 * basis(8).T, 8 * basis(8).T)
    return back.select("block", F.posexplode("t").alias("k", "v")).select("block", F.col("k").cast("long").alias("k"), (F.round("v", 5) + 0.0).alias("v"))


@query("trf04_low_frequencies", f"WITH {BLOCKS} SELECT block, x // 4 + 2 * (y // 4) AS cell, round(avg(v), 6) AS dc FROM (SELECT block, k % 8 AS x, k // 8 AS y, v FROM blk) GROUP BY block, x // 4 + 2 * (y // 4)")
def _(spark, sf):
    cell = F.expr("(k % 8) div 4 + 2 * ((k div 8) div 4)")
    return planes.vectors(spark, sf).groupBy("block", cell.alias("cell")).agg(F.round(F.avg("v"), 6).alias("dc"))


def weight(k):
    """Interpolated over bands of frequency, as a column of the position."""
    d = F.sqrt(F.pow(k % 8, F.lit(2.0)) + F.pow(F.floor(k / 8), F.lit(2.0)))
    return F.lit(32.0) * F.pow(F.lit(0.8), d)


_W = "32 * pow(0.8, sqrt(pow(k % 8, 2) + pow(k // 8, 2)))"


@query("trf05_quant_matrix", f"SELECT k, round({_W}, 6) AS w FROM range(64) AS t(k)")
def _(spark, sf):
    return spark.range(64).select(F.col("id").alias("k"), F.round(weight(F.col("id")), 6).alias("w"))


# Below these an AC coefficient is dropped, by quadrant of the block.
DEAD = (0.58, 0.635, 0.66, 0.7)
_THR = f"CASE WHEN k % 8 < 4 AND k // 8 < 4 THEN {DEAD[0]} WHEN k // 8 < 4 THEN {DEAD[1]} WHEN k % 8 < 4 THEN {DEAD[2]} ELSE {DEAD[3]} END"
_Q = f"{_DCT}, q AS (SELECT block, k, coef, coef * {_W} AS s, CASE WHEN k = 0 THEN round(coef * {_W}) WHEN abs(coef * {_W}) >= {_THR} THEN round(coef * {_W}) ELSE 0 END AS q FROM d)"


def quantised(spark, sf):
    k = F.col("k")
    left, top = k % 8 < 4, F.floor(k / 8) < 4
    dead = F.when(left & top, DEAD[0]).when(top, DEAD[1]).when(left, DEAD[2]).otherwise(DEAD[3])
    t = dct(spark, sf).withColumn("s", F.col("coef") * weight(k))
    return t.withColumn("q", F.when((k == 0) | (F.abs("s") >= dead), F.round("s")).otherwise(0.0))


@query("trf06_ac_quantise", f"WITH {_Q} SELECT block, k, CAST(q AS BIGINT) AS q FROM q")
def _(spark, sf):
    return quantised(spark, sf).select("block", "k", F.col("q").cast("long").alias("q"))


@query("trf07_dc_quantise", f"WITH {_Q}, m AS (SELECT block, max(CASE WHEN k = 0 THEN s END) AS y, max(CASE WHEN k = 1 THEN s END) AS c FROM q GROUP BY block) SELECT block, CAST(round(y) AS BIGINT) AS qy, CAST(round(c - 0.25 * round(y)) AS BIGINT) AS qc FROM m")
def _(spark, sf):
    m = quantised(spark, sf).groupBy("block").agg(F.max(F.when(F.col("k") == 0, F.col("s"))).alias("y"), F.max(F.when(F.col("k") == 1, F.col("s"))).alias("c"))
    return m.select("block", F.round("y").cast("long").alias("qy"), F.round(F.col("c") - F.round("y") * 0.25).cast("long").alias("qc"))


_BIAS = 1 - 0.07005450


@query("trf08_dequantise", f"WITH {_Q} SELECT block, round(sum(CASE WHEN q = 0 THEN 0 WHEN abs(q) = 1 THEN sign(q) * {_BIAS} ELSE q - 0.145 / q END), 5) AS total, round(sum(pow(s - CASE WHEN q = 0 THEN 0 WHEN abs(q) = 1 THEN sign(q) * {_BIAS} ELSE q - 0.145 / q END, 2)), 5) AS sse FROM q GROUP BY block")
def _(spark, sf):
    q = F.col("q")
    back = F.when(q == 0, 0.0).when(F.abs(q) == 1, F.signum(q) * _BIAS).otherwise(q - F.lit(0.145) / q)
    return quantised(spark, sf).groupBy("block").agg(F.round(F.sum(back), 5).alias("total"), F.round(F.sum(F.pow(F.col("s") - back, F.lit(2.0))), 5).alias("sse"))


@query("trf09_level_steps", f"WITH {LONG}, s AS (SELECT * FROM (VALUES (0, 2.0), (1, 4.0), (2, 9.0)) AS t(c, step)) SELECT img, c, CAST(sum(abs(round(v / step))) AS BIGINT) AS size FROM ch JOIN s USING (c) GROUP BY img, c")
def _(spark, sf):
    step = F.when(F.col("c") == 0, 2.0).when(F.col("c") == 1, 4.0).otherwise(9.0)
    return raw_channels(spark, sf).groupBy("img", "c").agg(F.sum(F.abs(F.round(F.col("v") / step))).cast("long").alias("size"))


@query("trf12_nearest_downsample", f"WITH {LONG} SELECT img, c, x // 4 AS x, y // 4 AS y, v FROM ch WHERE x % 4 = 0 AND y % 4 = 0")
def _(spark, sf):
    return raw_channels(spark, sf).filter("x % 4 = 0 and y % 4 = 0").select("img", "c", F.expr("x div 4").alias("x"), F.expr("y div 4").alias("y"), "v")


@query("trf13_coverage_split", f"""WITH {LONG}, t AS (SELECT img, i, v, min(v) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS lo, max(v) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hi FROM ch WHERE c = 0)
SELECT img, i, lo AS ink, hi AS base, CASE WHEN hi = lo THEN 0 ELSE CAST(round(255.0 * (hi - v) / (hi - lo)) AS BIGINT) END AS coverage FROM t""")
def _(spark, sf):
    w = W.partitionBy("img", "y").orderBy("x").rowsBetween(-2, 2)
    t = raw_channels(spark, sf).filter("c = 0").select("img", "i", "v", F.min("v").over(w).alias("ink"), F.max("v").over(w).alias("base"))
    return t.select("img", "i", "ink", "base", F.when(F.col("base") == F.col("ink"), 0).otherwise(F.round(F.lit(255.0) * (F.col("base") - F.col("v")) / (F.col("base") - F.col("ink")))).cast("long").alias("coverage"))


@query("agg12_chroma_regression", f"""WITH {LONG}, p AS (SELECT img, x // 16 AS tx, y // 16 AS ty, CAST(g AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM rgb), s AS (SELECT img, tx, ty, sum(a * a) AS aa, sum(a * (b - a)) AS ab, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT *, ab / (aa + 0.5 * n * 0.01) AS slope FROM s)
SELECT img, tx, ty, round(slope, 6) AS slope, CAST(CASE WHEN abs(slope) * 84 < 1.5 THEN 0 ELSE least(greatest(round(slope * 84), -128), 127) END AS BIGINT) AS factor FROM k""")
def _(spark, sf):
    px = planes.rgb8(spark, sf).select("img", F.expr("x div 16").alias("tx"), F.expr("y div 16").alias("ty"), F.col("g").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    s = px.groupBy("img", "tx", "ty").agg((F.sum(a * (b - a)) / (F.sum(a * a) + F.count("*") * 0.005)).alias("slope"))
    k = F.col("slope") * 84
    return s.select("img", "tx", "ty", F.round("slope", 6).alias("slope"), F.when(F.abs(k) < 1.5, 0).otherwise(F.least(F.greatest(F.round(k), F.lit(-128.0)), F.lit(127.0))).cast("long").alias("factor"))


@query("agg15_nonzero_counts", f"WITH {_Q} SELECT block, count(*) FILTER (WHERE q <> 0 AND k > 0) AS ac, count(*) FILTER (WHERE q <> 0 AND NOT (k % 8 < 2 AND k // 8 < 2)) AS beyond FROM q GROUP BY block")
def _(spark, sf):
    nz = F.col("q") != 0
    return quantised(spark, sf).groupBy("block").agg(F.count_if(nz & (F.col("k") > 0)).alias("ac"), F.count_if(nz & ~((F.col("k") % 8 < 2) & (F.floor(F.col("k") / 8) < 2))).alias("beyond"))


@query("agg16_position_tallies", f"WITH {_Q} SELECT k, count(*) FILTER (WHERE q <> 0) AS nz, count(*) AS n FROM q GROUP BY k")
def _(spark, sf):
    return quantised(spark, sf).groupBy("k").agg(F.count_if(F.col("q") != 0).alias("nz"), F.count("*").alias("n"))


@query("agg20_mean_laplacian", f"""WITH {BLOCKS}, b AS (SELECT block, k % 8 AS x, k // 8 AS y, v FROM blk), t AS (SELECT block, v, lag(v) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS d FROM b WINDOW r AS (PARTITION BY block, y ORDER BY x), c AS (PARTITION BY block, x ORDER BY y))
SELECT block, round(avg(abs(4 * v - coalesce(l, rr) - coalesce(rr, l) - coalesce(u, d) - coalesce(d, u))), 6) AS laplacian FROM t GROUP BY block""")
def _(spark, sf):
    """A block is one array: neighbours are array elements, mirrored at the block's edge."""
    at = lambda s, y, x: F.get(s, F.lit((abs(y) if y < 8 else 14 - y) * 8 + (abs(x) if x < 8 else 14 - x)))
    s = F.col("s")
    terms = [F.abs(at(s, y, x) * 4 - at(s, y, x - 1) - at(s, y, x + 1) - at(s, y - 1, x) - at(s, y + 1, x)) for y in range(8) for x in range(8)]
    return wide_blocks(spark, sf).select("block", F.round(sum(terms[1:], terms[0]) / 64, 6).alias("laplacian"))


@query("sup01_error_and_rate", f"WITH {_Q} SELECT block, round(sum(pow(s - q, 2)), 5) AS sse, round(sum(log2(1 + abs(q))), 5) AS rate FROM q GROUP BY block")
def _(spark, sf):
    return quantised(spark, sf).groupBy("block").agg(F.round(F.sum(F.pow(F.col("s") - F.col("q"), F.lit(2.0))), 5).alias("sse"), F.round(F.sum(F.log2(F.abs("q") + 1)), 5).alias("rate"))


@query("sup04_matrix_accounting", f"""WITH {_Q}, c AS (SELECT block // 8 AS region, m, sum(log2(1 + abs(round(s * scale)))) AS cost FROM q, (VALUES (0, 1.0), (1, 0.9), (2, 0.8)) AS t(m, scale) GROUP BY ALL), sets AS (SELECT mask FROM range(1, 8) AS t(mask)),
b AS (SELECT mask, region, min(cost) AS cost FROM c, sets WHERE (mask >> m) & 1 = 1 GROUP BY ALL), s AS (SELECT mask, round(sum(cost) + 64.0 * bit_count(mask::INT), 4) AS cost FROM b GROUP BY mask) SELECT CAST(mask AS BIGINT) AS mask, cost FROM s ORDER BY cost, mask LIMIT 1""")
def _(spark, sf):
    """Which sets of tables pay for their headers: every region takes the cheapest table of the set."""
    scales = (1.0, 0.9, 0.8)
    q = quantised(spark, sf).groupBy(F.expr("block div 8").alias("region")).agg(*[F.sum(F.log2(F.abs(F.round(F.col("s") * k)) + 1)).alias(f"c{m}") for m, k in enumerate(scales)])
    least = [F.sum(F.least(*[F.col(f"c{m}") for m in range(3) if mask >> m & 1]) if mask.bit_count() > 1 else F.col(f"c{mask.bit_length() - 1}")) + 64 * mask.bit_count() for mask in range(1, 8)]
    sums = q.agg(*[F.round(v, 4).alias(f"s{k + 1}") for k, v in enumerate(least)])
    best = F.array_min(F.array(*[F.struct(F.col(f"s{k}").alias("cost"), F.lit(k).cast("long").alias("mask")) for k in range(1, 8)]))
    return sums.select(best.alias("b")).select("b.mask", "b.cost")


@query("opt14_slope_search", f"""WITH {LONG}, p AS (SELECT img, s, b - g * s // 8 AS e FROM rgb, range(-8, 9) AS t(s)), h AS (SELECT img, s, e, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT img, s, round(CASE WHEN count(*) = 1 THEN 0 ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END, 4) AS bits FROM h GROUP BY img, s)
SELECT img, s AS slope, bits FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY bits, abs(s), s) AS k FROM c) WHERE k = 1""")
def _(spark, sf):
    """The slope whose residuals are cheapest; the flatter one wins ties."""
    px = planes.rgb8(spark, sf).groupBy("img", "g", "b").agg(F.count("*").alias("n"))  # colour pairs, not pixels
    p = px.withColumn("s", F.explode(F.sequence(F.lit(-8), F.lit(8)))).withColumn("e", F.expr("b - (g * s) div 8"))
    h = p.groupBy("img", "s", "e").agg(F.sum("n").alias("n"))
    bits = F.when(F.count("n") == 1, 0.0).otherwise(F.sum("n") * F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")))
    c = h.groupBy("img", "s").agg(F.round(bits, 4).alias("bits"))
    return c.groupBy("img").agg(F.min(F.struct("bits", F.abs("s").alias("a"), "s")).alias("k")).select("img", F.col("k.s").alias("slope"), "k.bits")


# A 16x16 site's eight layouts: whole, both halves across or down, one half of either merged, or none; with the quarters each part covers.
LAYOUTS = {"square": ((15,),), "across": ((3,), (12,)), "down": ((5,), (10,)), "top": ((3,), (4,), (8,)), "bottom": ((1,), (2,), (12,)), "left": ((5,), (2,), (8,)), "right": ((1,), (4,), (10,)), "none": ((1,), (2,), (4,), (8,))}
_PRICE = {1: 2.0, 2: 2.4, 4: 3.0}
_PARTS = sorted({p for parts in LAYOUTS.values() for (p,) in parts})
#: A merge must beat the parts by a margin.
_MARGIN = {"none": 1.0, "square": 1.03}


@query("opt03_merge_layouts", f"""WITH {LONG}, m AS (SELECT img, x // 16 AS bx, y // 16 AS bv, v, bit_or(1 << CAST((x // 8) % 2 + 2 * ((y // 8) % 2) AS INTEGER)) AS mask FROM ch WHERE c = 0 GROUP BY ALL),
p AS (SELECT img, bx, bv, {', '.join(f'{_PRICE[p.bit_count()]!r}::DOUBLE * count(*) FILTER (WHERE mask & {p} <> 0) + 4 AS p{p}' for p in _PARTS)} FROM m GROUP BY img, bx, bv),
l AS ({' UNION ALL '.join(f"SELECT img, bx, bv, '{n}' AS layout, {i} AS place, round(({' + '.join(f'p{q}' for (q,) in parts)}) * {_MARGIN.get(n, 1.01)!r}::DOUBLE, 4) AS cost FROM p" for i, (n, parts) in enumerate(LAYOUTS.items()))})
SELECT img, bx, bv, layout, cost FROM (SELECT *, row_number() OVER (PARTITION BY img, bx, bv ORDER BY cost, place) AS r FROM l) WHERE r = 1""")
def _(spark, sf):
    """The cheapest of a site's eight layouts, by the distinct values of each part; merged parts pay a margin. One scan gives all parts:
    each value brings the quarters that it stands in as bits."""
    quarter = F.expr("shiftleft(1, cast((x div 8) % 2 + 2 * ((y div 8) % 2) as int))")
    m = raw_channels(spark, sf).filter("c = 0").groupBy("img", F.expr("x div 16").alias("bx"), F.expr("y div 16").alias("bv"), "v").agg(F.bit_or(quarter).alias("mask"))
    p = m.groupBy("img", "bx", "bv").agg(*[(F.count_if(F.col("mask").bitwiseAND(F.lit(q)) != 0) * _PRICE[q.bit_count()] + 4).alias(f"p{q}") for q in _PARTS])
    rows = []
    for i, (name, parts) in enumerate(LAYOUTS.items()):
        cost = sum((F.col(f"p{q}") for (q,) in parts[1:]), F.col(f"p{parts[0][0]}"))
        rows.append(F.struct(F.round(cost * _MARGIN.get(name, 1.01), 4).alias("cost"), F.lit(i).alias("place"), F.lit(name).alias("layout")))
    return p.select("img", "bx", "bv", F.array_min(F.array(*rows)).alias("b")).select("img", "bx", "bv", "b.layout", "b.cost")
