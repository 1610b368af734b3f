"""Queries of the remaining stages: noise models, edge-preserving filters, fits, budgets and choices between codings."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.functions import codes, color
from mosaicq.operators import kernels as k
from mosaicq.operators.groups import by_groups, column
from mosaicq.operators.cost import entropy, shannon, token_cost
from mosaicq.operators.predict import neighbours, predictors, residual_tokens, tap
from mosaicq.plans.blocks import _Q, quantised
from mosaicq.plans.catalog import query
from mosaicq.plans.costs import _BITS, _ENT, _RES, residuals
from mosaicq.plans.kernels import by_planes, mask_of, plane_of, whole_rows
from mosaicq.plans.sql import LONG, RGB, SIGNAL, YCC, gradient_residual
from mosaicq.plans.sql import neighbours as nb_sql
from mosaicq.plans.windows import _tap_sql, raw_channels, squeeze_rows, ycc
from mosaicq.sources import planes

_FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def _taps(px, around=_FOUR):
    """px with t0, t1, ...: neighbours, the pixel itself where there is none."""
    return px.select("*", *[F.coalesce(tap(*o), F.col("v")).alias(f"t{n}") for n, o in enumerate(around)])


def _taps_sql(around=_FOUR) -> str:
    return ", ".join(f"coalesce({_tap_sql(*o)}, v) AS t{n}" for n, o in enumerate(around))


# Fixed values of the photon-noise model: photons per lx s and um2, quantum efficiency, read noise, response spread, sensor area, decoder's scale.
PHOTONS, EFFICIENCY, READ, SPREAD, AREA, NOISE_SCALE, NOISE_TOP = 11260.0, 0.20, 3.0, 0.005, 36000.0 * 24000.0, 0.22 * 2**0.5 * 1.13, 1023.4999 / 1024


@query("prj27_photon_noise", f"""WITH p AS (SELECT iso, i, 2.0 * i / 6 AS y FROM (VALUES (100.0), (800.0), (6400.0)) AS t(iso), range(8) AS r(i)), l AS (SELECT *, {EFFICIENCY * PHOTONS * 10 * AREA / 2e6!r} / iso AS e18, greatest(pow(y - {color.BIAS_CBRT}, 3) + {color.BIAS}, 0) AS linear FROM p),
n AS (SELECT *, e18 * linear / 0.18 AS e FROM l) SELECT iso, i AS point, round(least(greatest(sqrt({READ * READ} + e + pow({SPREAD} * e, 2)) * (0.18 / e18) / 3 / pow(cbrt(linear - {color.BIAS}), 2) / {NOISE_SCALE!r}, 0), {NOISE_TOP!r}), 6) AS strength FROM n""")
def _(spark, sf):
    """Read noise, shot noise and response spread of a two-megapixel sensor, as strength by intensity."""
    p = spark.range(8).select(F.col("id").alias("point"), F.explode(F.array(*[F.lit(v) for v in (100.0, 800.0, 6400.0)])).alias("iso"))
    e18 = F.lit(EFFICIENCY * PHOTONS * 10 * AREA / 2e6) / F.col("iso")
    linear = F.greatest(F.pow(F.col("point") * 2.0 / 6 - color.BIAS_CBRT, F.lit(3.0)) + color.BIAS, F.lit(0.0))
    e = e18 * linear / 0.18
    noise = F.sqrt(e + READ * READ + F.pow(e * SPREAD, F.lit(2.0))) * (F.lit(0.18) / e18) / 3 / F.pow(F.cbrt(linear - color.BIAS), F.lit(2.0))
    return p.select("iso", "point", F.round(F.least(F.greatest(noise / NOISE_SCALE, F.lit(0.0)), F.lit(NOISE_TOP)), 6).alias("strength"))


@query("src09_folder_scan")
def _(spark, sf):
    """Files of a folder by pattern, in path order; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(sf)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy("name")


# Options of an image as bits of a part's key; its sample depth is one of eight, two of them floats.
_IMAGE = "o AS (SELECT p_partkey, p_size % 8 AS kind, p_partkey % 8 AS turn, (p_partkey >> 3) & 1 AS alpha, (p_partkey >> 4) & 1 AS xyb, (p_partkey >> 5) & 1 AS bright FROM part)"
_DEPTH = "CASE kind WHEN 0 THEN 8 WHEN 1 THEN 10 WHEN 2 THEN 12 WHEN 3 THEN 16 WHEN 4 THEN 14 WHEN 5 THEN 9 WHEN 6 THEN 32 ELSE 16 END"
_DEPTH_BITS = "CASE WHEN kind >= 6 THEN 7 WHEN kind <= 2 THEN 3 ELSE 9 END"
_METADATA = f"1 + 1 + extra * 6 + {_DEPTH_BITS} + 1 + 2 + alpha + 1 + 1 + extra * CASE WHEN bright = 1 THEN 1 + 16 + 16 + 1 + 16 ELSE 1 END + 2 + 1"


@query("snk05_metadata_bits", f"WITH {_IMAGE}, e AS (SELECT *, CASE WHEN turn > 0 OR bright = 1 THEN 1 ELSE 0 END AS extra, {_DEPTH} AS depth FROM o) SELECT p_partkey, CAST(depth AS BIGINT) AS depth, CAST({_METADATA} AS BIGINT) AS bits, kind < 6 AND xyb = 0 AND depth >= 16 AS level10 FROM e")
def _(spark, sf):
    """Bits of an image's description: orientation and tone mapping where they aren't plain, depth, extra channel, colour as usual."""
    bit = lambda k: F.shiftright("p_partkey", k).bitwiseAND(F.lit(1))
    o = planes.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 8).alias("kind"), (F.col("p_partkey") % 8).alias("turn"), bit(3).alias("alpha"), bit(4).alias("xyb"), bit(5).alias("bright"))
    e = o.withColumns({"extra": F.expr("CASE WHEN turn > 0 OR bright = 1 THEN 1 ELSE 0 END"), "depth": F.expr(_DEPTH).cast("long")})
    return e.select("p_partkey", "depth", F.expr(_METADATA).cast("long").alias("bits"), F.expr("kind < 6 AND xyb = 0 AND depth >= 16").alias("level10"))


@query("flt17_primaries_match", f"""WITH m AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {i}, {v!r})" for n in ('srgb', 'p3', 'bt2020') for i, v in enumerate(color.to_srgb_matrix(n).reshape(-1).tolist()))}) AS t(name, k, v)), s AS (SELECT name, max(abs(v - CASE WHEN k IN (0, 4, 8) THEN 1 ELSE 0 END)) AS off FROM m GROUP BY name)
SELECT name, round(off, 6) AS off, off <= 0.001 AS same FROM s""")
def _(spark, sf):
    """Which primaries are the working space's own, within a tolerance."""
    rows = [(n, float(np.abs(color.to_srgb_matrix(n) - np.eye(3)).max())) for n in ("srgb", "p3", "bt2020")]
    return spark.createDataFrame(rows, "name string, off double").select("name", F.round("off", 6).alias("off"), (F.col("off") <= 0.001).alias("same"))


# filters -----------------------------------------------------------------------------------------------------------


def _edge_sql(width: float) -> str:
    w = [f"greatest(0, 1 - abs(v - t{n}) / {width!r})" for n in range(4)]
    return f"(v + {' + '.join(f'{a} * t{n}' for n, a in enumerate(w))}) / (1 + {' + '.join(w)})"


def edge_preserving(t, width: float):
    """A mean of a pixel and its neighbours that drops those too far from it."""
    v = F.col("v").cast("double")
    w = [F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(v - F.col(f"t{n}")) / width) for n in range(4)]
    return (v + sum(a * F.col(f"t{n}") for n, a in enumerate(w))) / (sum(w[1:], w[0]) + 1)


# Widths of the three passes; each starts from what the one before left.
_PASSES = (40.0, 60.0, 30.0)


def _passes_sql() -> str:
    steps = ["s0 AS (SELECT img, c, i, x, y, CAST(v AS DOUBLE) AS v FROM ch)"]
    for n, width in enumerate(_PASSES):
        steps += [f"n{n} AS (SELECT *, {_taps_sql()} FROM s{n})", f"s{n + 1} AS (SELECT img, c, i, x, y, {_edge_sql(width)} AS v FROM n{n})"]
    return ", ".join(steps)


@query("win12_edge_preserving", f"WITH {LONG}, {_passes_sql()} SELECT img, c, i, round(v, 5) AS out FROM s{len(_PASSES)}")
def _(spark, sf):
    s = raw_channels(spark, sf).withColumn("v", F.col("v").cast("double"))
    for width in _PASSES:
        t = _taps(s)
        s = t.select("img", "c", "i", "x", "y", edge_preserving(t, width).alias("v"))
    return s.select("img", "c", "i", F.round("v", 5).alias("out"))


_STRENGTHS = (10.0, 20.0, 40.0, 80.0)
_COARSE = f"{LONG}, src AS (SELECT img, c, i, x, y, v AS truth, (v // 6) * 6 + 3 AS v FROM ch WHERE c = 0), t AS (SELECT *, {_taps_sql()} FROM src)"


@query("sup09_strength_fit", f"WITH {_COARSE}, e AS ({' UNION ALL '.join(f'SELECT img, {s} AS strength, round(sum(pow({_edge_sql(s)} - truth, 2)), 4) AS sse FROM t GROUP BY img' for s in _STRENGTHS)}) SELECT img, CAST(strength AS DOUBLE) AS strength, sse FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY sse, strength) AS r FROM e) WHERE r = 1")
def _(spark, sf):
    """Every strength is an aggregate of the same taps; the least error wins."""
    src = raw_channels(spark, sf).filter("c = 0").withColumn("truth", F.col("v")).withColumn("v", F.expr("(v div 6) * 6 + 3"))
    t = _taps(src)
    sums = t.groupBy("img").agg(*[F.round(F.sum(F.pow(edge_preserving(t, s) - F.col("truth"), F.lit(2.0))), 4).alias(f"s{n}") for n, s in enumerate(_STRENGTHS)])
    best = F.array_min(F.array(*[F.struct(F.col(f"s{n}").alias("sse"), F.lit(s).alias("strength")) for n, s in enumerate(_STRENGTHS)]))
    return sums.select("img", best.alias("b")).select("img", "b.strength", "b.sse")


@query("win19_edge_contours", f"""WITH {LONG}, t AS (SELECT *, {_taps_sql()} FROM ch WHERE c = 0), g AS (SELECT img, c, i, x, y, abs(t1 - t0) AS gx, abs(t3 - t2) AS gy, abs(t1 - t0) + abs(t3 - t2) AS v FROM t), n AS (SELECT *, {_taps_sql()} FROM g)
SELECT img, count(*) AS edges, CAST(sum(v) AS BIGINT) AS strength FROM n WHERE v >= 100 AND ((gx >= gy AND v >= t0 AND v > t1) OR (gx < gy AND v >= t2 AND v > t3)) GROUP BY img""")
def _(spark, sf):
    """Pixels whose gradient is a maximum along itself."""
    t = _taps(raw_channels(spark, sf).filter("c = 0")).select("img", "c", "i", "x", "y", F.expr("abs(t1 - t0)").alias("gx"), F.expr("abs(t3 - t2)").alias("gy"))
    n = _taps(t.withColumn("v", F.col("gx") + F.col("gy")))
    edge = n.filter("v >= 100 and ((gx >= gy and v >= t0 and v > t1) or (gx < gy and v >= t2 and v > t3))")
    return edge.groupBy("img").agg(F.count("*").alias("edges"), F.sum("v").alias("strength"))


_DIFF = "CASE WHEN a = 0 THEN (t0 + t1 + t2 + t3) / 4.0 ELSE v END"


@query("win23_diffusion", f"""WITH {RGB}, s0 AS (SELECT img, 0 AS c, i, x, y, a, CAST(g AS DOUBLE) AS v FROM rgb), n0 AS (SELECT *, {_taps_sql()} FROM s0), s1 AS (SELECT img, c, i, x, y, a, {_DIFF} AS v FROM n0), n1 AS (SELECT *, {_taps_sql()} FROM s1)
SELECT img, i, round({_DIFF}, 6) AS v FROM n1 WHERE a = 0""")
def _(spark, sf):
    """What nobody sees is smoothed twice from its neighbours."""
    s = planes.rgb8(spark, sf).select("img", F.lit(0).alias("c"), "i", "x", "y", "a", F.col("g").cast("double").alias("v"))
    for _ in range(2):
        s = _taps(s).withColumn("v", F.when(F.col("a") == 0, F.expr("(t0 + t1 + t2 + t3) / 4D")).otherwise(F.col("v"))).drop("t0", "t1", "t2", "t3")
    return s.filter("a = 0").select("img", "i", F.round("v", 6).alias("v"))


_BEYOND = "CASE WHEN top THEN greatest(v, (t0 + t1 + t2 + t3) // 4 + 10) ELSE v END"


def _continued_sql() -> str:
    steps = ["s0 AS (SELECT img, c, i, x, y, v, v >= 240 AS top FROM ch)"]
    for n in range(3):
        steps += [f"n{n} AS (SELECT *, {_taps_sql()} FROM s{n})", f"s{n + 1} AS (SELECT img, c, i, x, y, {_BEYOND} AS v, top FROM n{n})"]
    return ", ".join(steps)


@query("sup02_saturated_pixels", f"WITH {LONG}, {_continued_sql()} SELECT img, c, count(*) AS samples, count(*) FILTER (WHERE top) AS saturated, count(*) FILTER (WHERE top) * 50 >= count(*) AS pays, CAST(sum(v) AS BIGINT) AS total, max(v) AS most FROM s3 GROUP BY img, c")
def _(spark, sf):
    """Saturated samples go on beyond the limit in three rounds, each from what its neighbours have by then; it pays from 2 % on."""
    s = raw_channels(spark, sf).withColumn("top", F.col("v") >= 240)
    for _ in range(3):
        t = _taps(s)
        beyond = F.greatest(F.col("v"), F.expr("(t0 + t1 + t2 + t3) div 4 + 10"))
        s = t.select("img", "c", "i", "x", "y", F.when(F.col("top"), beyond).otherwise(F.col("v")).alias("v"), "top")
    n, m = F.count("*"), F.count_if("top")
    return s.groupBy("img", "c").agg(n.alias("samples"), m.alias("saturated"), (m * 50 >= n).alias("pays"), F.sum("v").alias("total"), F.max("v").alias("most"))


# prices and trees ---------------------------------------------------------------------------------------------------


@query("ent06_header_bits", f"WITH {_RES}, h AS (SELECT DISTINCT img % 16 AS ctx, token FROM res), g AS (SELECT ctx, token - coalesce(lag(token) OVER (PARTITION BY ctx ORDER BY token), -1) AS gap FROM h) SELECT ctx, count(*) AS symbols, CAST(sum(2 * length(bin(gap)) - 1 + 4) AS BIGINT) AS bits FROM g GROUP BY ctx")
def _(spark, sf):
    """A table of lengths: gaps between used symbols, and four bits for each."""
    h = residuals(spark, sf).select((F.col("img") % 16).alias("ctx"), "token").distinct()
    g = h.select("ctx", (F.col("token") - F.coalesce(F.lag("token").over(W.partitionBy("ctx").orderBy("token")), F.lit(-1))).alias("gap"))
    return g.groupBy("ctx").agg(F.count("*").alias("symbols"), F.sum(F.length(F.bin("gap")) * 2 + 3).alias("bits"))


@query("opt05_learned_prices", f"""WITH {_RES}, h AS (SELECT token, count(*) AS n FROM res GROUP BY token), p AS (SELECT token, log2((CAST(sum(n) OVER () AS DOUBLE) + 0.5 * 128) / (n + 0.5)) AS price FROM h), z AS (SELECT log2((CAST(sum(n) AS DOUBLE) + 0.5 * 128) / 0.5) AS price FROM h)
SELECT img, round(sum(coalesce(p.price, z.price) + nbits), 3) AS bits FROM res LEFT JOIN p USING (token) CROSS JOIN z GROUP BY img""")
def _(spark, sf):
    """Prices from a first pass over all residuals, paid by each image; the alphabet's rows are broadcast."""
    res = residuals(spark, sf)
    h = res.groupBy("token").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy()).cast("double") + 64
    p = h.select("token", F.log2(total / (F.col("n") + 0.5)).alias("price"), F.log2(total / 0.5).alias("unknown"))
    counts = res.groupBy("img", "token").agg(F.count("*").alias("m"), F.sum("nbits").alias("raw"))
    worst = p.agg(F.max("unknown").alias("unknown"))
    paid = counts.join(F.broadcast(p.select("token", "price")), "token", "left").join(F.broadcast(worst))
    return paid.groupBy("img").agg(F.round(F.sum(F.coalesce("price", "unknown") * F.col("m") + F.col("raw")), 3).alias("bits"))


@query("sup07_context_plan", f"""WITH {_RES}, h AS (SELECT c, y % 2 AS half, token, count(*) AS n FROM res GROUP BY ALL), s AS (SELECT c, half, {_ENT} AS bits FROM h GROUP BY c, half), m AS (SELECT c, token, sum(n) AS n FROM h GROUP BY c, token), w AS (SELECT c, {_ENT} AS merged FROM m GROUP BY c)
SELECT c, round(merged, 3) AS merged, round(sum(bits), 3) AS split, sum(bits) + 64 < merged AS keep FROM s JOIN w USING (c) GROUP BY c, merged""")
def _(spark, sf):
    """A split of contexts stays where it saves more than its header."""
    h = residuals(spark, sf).groupBy("c", "token").agg(F.count_if(F.col("y") % 2 == 0).alias("a"), F.count_if(F.col("y") % 2 == 1).alias("b"))
    bits = lambda n: F.sum(n) * F.log2(F.sum(n)) - F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0))
    s = h.groupBy("c").agg(bits(F.col("a") + F.col("b")).alias("m"), (bits(F.col("a")) + bits(F.col("b"))).alias("s"))
    return s.select("c", F.round("m", 3).alias("merged"), F.round("s", 3).alias("split"), (F.col("s") + 64 < F.col("m")).alias("keep"))


_LEAF = "CASE WHEN abs(w - n) > 24 THEN 3 WHEN w + n - nw > 60 THEN 2 WHEN y > 8 THEN 1 ELSE 0 END"


@query("sup15_tree_tokens", f"""WITH {YCC}, {nb_sql('ych')}, {gradient_residual()}, l AS (SELECT img, c, i, {_LEAF} AS leaf FROM nb), h AS (SELECT c, leaf, token, count(*) AS n, sum(nbits) AS raw FROM res JOIN l USING (img, c, i) GROUP BY ALL)
SELECT c, leaf, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(raw) AS BIGINT) AS raw_bits, round({_BITS}, 3) AS bits FROM h GROUP BY c, leaf""")
def _(spark, sf):
    """A tree's leaf is the context of what its predictor leaves."""
    nb = neighbours(ycc(spark, sf)).withColumn("leaf", F.expr(_LEAF)).withColumn("z", codes.zigzag(F.col("v") - predictors()[5]))
    t = nb.select("c", "leaf", codes.hybrid_token(F.col("z")).alias("token"), codes.hybrid_bits(F.col("z")).alias("nbits"))
    return token_cost(t, "c", "leaf").withColumn("bits", F.round("bits", 3))


@query("sup14_channel_tokens", f"""WITH {YCC}, {nb_sql('ych')}, e AS (SELECT c, v - CASE c WHEN 0 THEN w WHEN 1 THEN n ELSE (w + n) // 2 END AS e FROM nb), z AS (SELECT c, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z FROM e), k AS (SELECT *, length(bin(z)) - 1 AS k FROM z),
h AS (SELECT c, CASE WHEN z < 16 THEN z ELSE 4 * k + ((z - (1::BIGINT << k::INT)) >> (k - 2)::INT) END AS token, count(*) AS n FROM k GROUP BY ALL) SELECT c, round({_BITS}, 3) AS bits FROM h GROUP BY c""")
def _(spark, sf):
    """Each channel with a predictor of its own."""
    p = predictors()
    own = F.when(F.col("c") == 0, p[1]).when(F.col("c") == 1, p[2]).otherwise(p[3])
    h = residual_tokens(ycc(spark, sf), own).groupBy("c", "token").agg(F.count("*").alias("n"))
    return h.groupBy("c").agg(F.round(shannon(), 3).alias("bits"))


@query("sup16_local_trees")
def _(spark, sf):
    """A tree per plane where its leaves save more than its nodes cost."""

    def run(x: np.ndarray, symbol: np.ndarray) -> tuple:
        flat = k.grow_tree(x, symbol, 1)[0][2]
        nodes = k.grow_tree(x, symbol, 6)
        tree = sum(t[2] for t in k.tree_leaves(nodes)) + 20.0 * (len(nodes) // 2)
        return round(flat, 3), round(tree, 3), bool(tree < flat)

    return by_planes(spark, sf, run, "flat_bits double, tree_bits double, kept boolean")


@query("sup17_divided_channels", f"WITH {LONG}, f AS (SELECT c, CASE c WHEN 0 THEN 5 WHEN 1 THEN 25 ELSE 31 END AS f FROM range(3) AS t(c)), h AS (SELECT c, v // f AS q, count(*) AS n FROM ch JOIN f USING (c) GROUP BY ALL) SELECT c, count(*) AS levels, max(q) AS most, round({_ENT}, 3) AS bits FROM h GROUP BY c")
def _(spark, sf):
    """Channels stored divided by their step: the same entropy over a dense alphabet."""
    step = F.when(F.col("c") == 0, 5).when(F.col("c") == 1, 25).otherwise(31)
    h = raw_channels(spark, sf).groupBy("c", F.floor(F.col("v") / step).alias("q")).agg(F.count("*").alias("n"))
    return h.groupBy("c").agg(F.count("*").alias("levels"), F.max("q").alias("most"), F.round(entropy(), 3).alias("bits"))


_ALPHA = f"{RGB}, al AS (SELECT img, i, b AS v FROM rgb), h0 AS (SELECT img, v AS s, count(*) AS n FROM al GROUP BY ALL), h1 AS (SELECT img, d AS s, count(*) AS n FROM (SELECT img, v - coalesce(lag(v) OVER (PARTITION BY img ORDER BY i), 0) AS d FROM al) GROUP BY ALL)"


@query("sup10_extra_channel", f"""WITH {_ALPHA}, p AS (SELECT img, {_ENT} + 8 * count(*) AS bits FROM h0 GROUP BY img), d AS (SELECT img, {_ENT} AS bits FROM h1 GROUP BY img) SELECT p.img, round(p.bits, 3) AS palette_bits, round(d.bits, 3) AS delta_bits, CASE WHEN p.bits <= d.bits THEN 'palette' ELSE 'delta' END AS choice FROM p JOIN d USING (img)""")
def _(spark, sf):
    al = planes.rgb8(spark, sf).select("img", F.col("b").alias("v"), (F.col("b") - F.coalesce(F.lag("b").over(W.partitionBy("img").orderBy("i")), F.lit(0))).alias("d"))
    both = al.select("img", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("v").alias("s")), F.struct(F.lit(1).alias("k"), F.col("d").alias("s")))).alias("t"))
    h = both.groupBy("img", "t.k", "t.s").agg(F.count("*").alias("n")).groupBy("img", "k").agg(entropy().alias("e"), F.count("*").alias("m"))
    at = lambda j, e: F.max(F.when(F.col("k") == j, e))
    c = h.groupBy("img").agg(at(0, F.col("e") + F.col("m") * 8).alias("p"), at(1, F.col("e")).alias("d"))
    return c.select("img", F.round("p", 3).alias("palette_bits"), F.round("d", 3).alias("delta_bits"), F.when(F.col("p") <= F.col("d"), "palette").otherwise("delta").alias("choice"))


@query("sup11_alpha_squeeze", f"""WITH {RGB}, p AS (SELECT img, y, x, b AS v, lead(b) OVER (PARTITION BY img, y ORDER BY x) AS n FROM rgb), q AS (SELECT img, CASE WHEN n IS NULL THEN v ELSE (v + n + (v > n)::INT) >> 1 END AS avg, v - n AS diff FROM p WHERE x % 2 = 0)
SELECT img, count(*) AS pairs, CAST(sum(avg) AS BIGINT) AS low, CAST(sum(abs(diff) // 4) AS BIGINT) AS detail FROM q GROUP BY img""")
def _(spark, sf):
    sq = squeeze_rows(planes.rgb8(spark, sf).select("img", F.lit(0).alias("c"), "i", "x", "y", F.col("b").alias("v")))
    return sq.groupBy("img").agg(F.count("*").alias("pairs"), F.sum("avg").alias("low"), F.sum(F.expr("abs(diff) div 4")).alias("detail"))


@query("sup12_staged_bits", f"""WITH {YCC}, p AS (SELECT img, c, y, x, v, lead(v) OVER (PARTITION BY img, c, y ORDER BY x) AS n FROM ych), q AS (SELECT c, CAST(round((v - n) / CASE c WHEN 0 THEN 2.0 ELSE 4.0 END) AS BIGINT) AS q FROM p WHERE x % 2 = 0 AND n IS NOT NULL),
h AS (SELECT c, q, count(*) AS n FROM q GROUP BY ALL) SELECT c, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(n) FILTER (WHERE q = 0) AS BIGINT) AS zeros, round({_ENT}, 3) AS bits FROM h GROUP BY c""")
def _(spark, sf):
    """Pyramid, steps, tokens, bits in one plan."""
    step = F.when(F.col("c") == 0, 2.0).otherwise(4.0)
    h = squeeze_rows(ycc(spark, sf)).filter("diff is not null").groupBy("c", F.round(F.col("diff") / step).cast("long").alias("q")).agg(F.count("*").alias("n"))
    return h.groupBy("c").agg(F.sum("n").alias("samples"), F.sum(F.when(F.col("q") == 0, F.col("n"))).alias("zeros"), F.round(entropy(), 3).alias("bits"))


@query("sup21_pyramid_crops", f"""WITH {LONG}, l AS (SELECT img, c, s, x >> s AS px, y >> s AS py FROM ch, range(3) AS t(s) WHERE x % (1 << s::INT) = 0 AND y % (1 << s::INT) = 0) SELECT s AS level, px // (16 >> s::INT) AS gx, py // (16 >> s::INT) AS gy, count(*) AS samples FROM (SELECT img, c, s::INT AS s, px, py FROM l) GROUP BY ALL""")
def _(spark, sf):
    """Groups cover the same part of the image at every level."""
    ch = raw_channels(spark, sf)
    rows = [F.when((F.col("x") % (1 << s) == 0) & (F.col("y") % (1 << s) == 0), F.struct(F.lit(s).alias("level"), F.expr(f"(x >> {s}) div {16 >> s}").alias("gx"), F.expr(f"(y >> {s}) div {16 >> s}").alias("gy"))) for s in range(3)]
    return ch.select(F.explode(F.array_compact(F.array(*rows))).alias("t")).groupBy("t.level", "t.gx", "t.gy").agg(F.count("*").alias("samples"))


# quantisation fits --------------------------------------------------------------------------------------------------


@query("sup03_dc_compensation", f"WITH {_Q}, m AS (SELECT block, max(CASE WHEN k = 0 THEN s END) AS y, max(CASE WHEN k = 0 THEN q END) AS yq, max(CASE WHEN k = 8 THEN s END) AS b FROM q GROUP BY block) SELECT block, round(y - yq, 6) AS error, CAST(round(b + 0.5 * (y - yq)) AS BIGINT) AS target, round(pow(b + 0.5 * (y - yq) - round(b + 0.5 * (y - yq)), 2), 6) AS distortion FROM m")
def _(spark, sf):
    at = lambda kk, c: F.max(F.when(F.col("k") == kk, F.col(c)))
    m = quantised(spark, sf).groupBy("block").agg(at(0, "s").alias("y"), at(0, "q").alias("yq"), at(8, "s").alias("b"))
    e = F.col("y") - F.col("yq")
    t = F.col("b") + e * 0.5
    return m.select("block", F.round(e, 6).alias("error"), F.round(t).cast("long").alias("target"), F.round(F.pow(t - F.round(t), F.lit(2.0)), 6).alias("distortion"))


@query("sup05_lost_detail", f"WITH {_Q} SELECT block, round(sum(CASE WHEN q = 0 AND k > 0 THEN s * s ELSE 0 END), 5) AS lost, round(sum(CASE WHEN k > 0 THEN s * s ELSE 0 END), 5) AS detail, sum(CASE WHEN q = 0 AND k > 0 THEN s * s ELSE 0 END) > 0.5 * sum(CASE WHEN k > 0 THEN s * s ELSE 0 END) AS boost FROM q GROUP BY block")
def _(spark, sf):
    s2 = F.col("s") * F.col("s")
    lost, detail = F.sum(F.when((F.col("q") == 0) & (F.col("k") > 0), s2).otherwise(0.0)), F.sum(F.when(F.col("k") > 0, s2).otherwise(0.0))
    return quantised(spark, sf).groupBy("block").agg(F.round(lost, 5).alias("lost"), F.round(detail, 5).alias("detail"), (lost > detail * 0.5).alias("boost"))


@query("sup06_slope_costs", f"""WITH {RGB}, p AS (SELECT img, x // 16 AS tx, y // 16 AS ty, s, sum(log2(1 + abs(b - g * s // 8))) AS bits FROM rgb, range(-4, 5) AS t(s) GROUP BY ALL) SELECT img, tx, ty, s AS slope, round(bits, 4) AS bits FROM (SELECT *, row_number() OVER (PARTITION BY img, tx, ty ORDER BY round(bits, 4), abs(s), s) AS k FROM p) WHERE k = 1""")
def _(spark, sf):
    """Slopes are columns of one aggregate per tile."""
    slopes = range(-4, 5)
    sums = planes.rgb8(spark, sf).groupBy("img", F.expr("x div 16").alias("tx"), F.expr("y div 16").alias("ty")).agg(*[F.round(F.sum(F.log2(F.abs(F.expr(f"b - (g * {s}) div 8")) + 1)), 4).alias(f"s{n}") for n, s in enumerate(slopes)])
    best = F.array_min(F.array(*[F.struct(F.col(f"s{n}").alias("bits"), F.lit(abs(s)).alias("a"), F.lit(s).alias("slope")) for n, s in enumerate(slopes)]))
    return sums.select("img", "tx", "ty", best.alias("b")).select("img", "tx", "ty", "b.slope", "b.bits")


def _level_sql(size: int, price: int) -> str:
    return f"SELECT img, x // {size} AS bx, y // {size} AS bv, CAST(count(DISTINCT v) AS DOUBLE) * {price} + 4 AS cost FROM ch WHERE c = 0 GROUP BY ALL"


@query("opt04_quadtree_layout", f"""WITH {LONG}, a AS ({_level_sql(8, 3)}), b AS ({_level_sql(16, 4)}), d AS ({_level_sql(32, 6)}), ab AS (SELECT b.img, b.bx, b.bv, least(b.cost, s.cost) AS cost FROM b JOIN (SELECT img, bx // 2 AS bx, bv // 2 AS bv, sum(cost) AS cost FROM a GROUP BY ALL) s USING (img, bx, bv))
SELECT d.img, d.bx, d.bv, d.cost AS whole, least(d.cost, s.cost) AS best FROM d JOIN (SELECT img, bx // 2 AS bx, bv // 2 AS bv, sum(cost) AS cost FROM ab GROUP BY ALL) s USING (img, bx, bv)""")
def _(spark, sf):
    """Bottom up: a square costs what it costs whole or what its quarters cost, whichever is less."""
    d = raw_channels(spark, sf).filter("c = 0").select("img", F.expr("x div 8").alias("bx"), F.expr("y div 8").alias("bv"), "v").distinct()
    best = d.groupBy("img", "bx", "bv").agg((F.count("*") * 3.0 + 4).alias("cost"))
    for price in (4.0, 6.0):
        up = [F.expr("bx div 2").alias("bx"), F.expr("bv div 2").alias("bv")]
        d = d.select("img", *up, "v").distinct()
        whole = d.groupBy("img", "bx", "bv").agg((F.count("*") * price + 4).alias("whole"))
        parts = best.groupBy("img", *up).agg(F.sum("cost").alias("parts"))
        both = whole.join(parts, ["img", "bx", "bv"])
        best = both.select("img", "bx", "bv", "whole", F.least("whole", "parts").alias("cost"))
    return best.select("img", "bx", "bv", "whole", F.col("cost").alias("best"))


@query("opt11_line_fits", f"WITH {SIGNAL} SELECT user_id, count(*) AS n, round(regr_slope(CAST(v AS DOUBLE), t), 4) AS slope, round(regr_intercept(CAST(v AS DOUBLE), t), 3) AS intercept, round(regr_r2(CAST(v AS DOUBLE), t), 6) AS r2 FROM sig GROUP BY user_id HAVING count(*) > 2")
def _(spark, sf):
    v = F.col("v").cast("double")
    s = planes.signal(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.regr_slope(v, F.col("t")), 4).alias("slope"), F.round(F.regr_intercept(v, F.col("t")), 3).alias("intercept"), F.round(F.regr_r2(v, F.col("t")), 6).alias("r2"))
    return s.filter("n > 2")


@query("opt12_greedy_acceptance", f"""WITH {_Q}, p AS (SELECT block, k, q, s * s - pow(s - q, 2) AS gain, 2.5 + 2 * log2(1 + abs(q)) AS bits FROM q WHERE q <> 0) SELECT block, count(*) AS accepted, round(sum(gain), 4) AS gain, round(sum(bits), 4) AS bits FROM p WHERE gain > 0.2 * bits GROUP BY block""")
def _(spark, sf):
    """Coefficients stay where what they gain is worth their bits."""
    s, q = F.col("s"), F.col("q")
    p = quantised(spark, sf).filter("q <> 0").select("block", (s * s - F.pow(s - q, F.lit(2.0))).alias("gain"), (F.log2(F.abs(q) + 1) * 2 + 2.5).alias("bits"))
    return p.filter(F.col("gain") > F.col("bits") * 0.2).groupBy("block").agg(F.count("*").alias("accepted"), F.round(F.sum("gain"), 4).alias("gain"), F.round(F.sum("bits"), 4).alias("bits"))


@query("opt13_separable_fit", f"""WITH {LONG}, m AS (SELECT img, c, CAST(v AS DOUBLE) AS v, avg(v) OVER (PARTITION BY img, c, x) AS u, avg(v) OVER (PARTITION BY img, c, y) AS w, avg(v) OVER (PARTITION BY img, c) AS m FROM ch) SELECT img, c, round(sqrt(avg(pow(v - u - w + m, 2))), 6) AS rest, round(stddev_pop(v), 6) AS before FROM m GROUP BY img, c""")
def _(spark, sf):
    """What is left of a plane after the best sum of a function of x and one of y."""
    ch = raw_channels(spark, sf)
    over = lambda *by: F.avg("v").over(W.partitionBy("img", "c", *by))
    m = ch.select("img", "c", F.col("v").cast("double").alias("v"), over("x").alias("u"), over("y").alias("w"), over().alias("m"))
    return m.groupBy("img", "c").agg(F.round(F.sqrt(F.avg(F.pow(F.expr("v - u - w + m"), F.lit(2.0)))), 6).alias("rest"), F.round(F.stddev_pop("v"), 6).alias("before"))


@query("opt09_threshold_contexts")
def _(spark, sf):
    """Runs of DC values that share a context: levels of least error over a histogram."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("v")
        error, levels = k.best_levels(p.v.to_numpy(float), p.n.to_numpy(float), 5)
        return pd.DataFrame({"c": [p.c.iloc[0]], "error": [round(error, 3)], "contexts": [len(levels)]})

    h = raw_channels(spark, sf).groupBy("c", "v").agg(F.count("*").alias("n"))
    return h.groupBy("c").applyInPandas(run, "c int, error double, contexts long")


@query("opt16_preset_fit")
def _(spark, sf):
    """The best of the weighted predictor's presets for each plane, by what it leaves."""

    def run(px: pa.Table, starts: np.ndarray) -> dict:
        rows, y, at = whole_rows(column(px, "r"), starts)
        size = np.stack([np.add.reduceat(np.abs(k.weighted_residuals_of(rows, y, s, t).reshape(-1)[at]), starts) for s, t in k.WP_PRESETS])
        return {"img": px["img"].combine_chunks().take(pa.array(starts)), "preset": size.argmin(axis=0), "size": size.min(axis=0)}

    return by_groups(planes.rgb8(spark, sf).select("img", "i", "r"), ["img"], "i", run, "img long, preset long, size long")


@query("seg09_merged_regions")
def _(spark, sf):
    """Boxes of bright components, merged until none overlap; the mask is grown and shrunk first, so that small gaps close."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = k.components8(k.shrunk(k.grown(mask_of(pdf))))
        boxes = [(xs.min() - 1, ys.min() - 1, xs.max() + 1, ys.max() + 1) for ys, xs in (np.nonzero(label == r) for r in np.unique(label[label >= 0]))]
        out = k.merge_boxes([tuple(map(int, b)) for b in boxes])
        return pd.DataFrame({"img": pdf.img.iloc[0], "x0": [b[0] for b in out], "y0": [b[1] for b in out], "x1": [b[2] for b in out], "y1": [b[3] for b in out]})

    ink = planes.rgb8(spark, sf).filter("r > 240").select("img", "x", "y")
    return ink.groupBy("img").applyInPandas(run, "img long, x0 long, y0 long, x1 long, y1 long")


@query("seg11_traced_chains")
def _(spark, sf):
    """Polylines through neighbouring bright pixels, the brightest first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chains = k.trace_chains(plane_of(pdf, "r"), 215)
        return pd.DataFrame({"img": [pdf.img.iloc[0]], "chains": [len(chains)], "longest": [max(map(len, chains), default=0)], "pixels": [sum(map(len, chains))]})

    return planes.rgb8(spark, sf).select("img", "i", "r").groupBy("img").applyInPandas(run, "img long, chains long, longest long, pixels long")


# hooks --------------------------------------------------------------------------------------------------------------


@query("ext01_compressor_hook")
def _(spark, sf, compress=lambda raw: zlib.compress(raw, 6)):
    """A user's compressor over metadata; it is used where it is smaller."""

    def run(batches):
        for pdf in batches:
            plain = [t.encode() for t in pdf["html"].fillna("")]
            packed = [compress(p) for p in plain]
            yield pd.DataFrame({"page_id": pdf["page_id"], "plain": list(map(len, plain)), "stored": [min(len(a), len(b)) for a, b in zip(plain, packed, strict=True)]})

    return planes.table(spark, sf, "pages").select("page_id", "html").mapInPandas(run, "page_id long, plain long, stored long")


@query("ext02_tuning_rows", "WITH t AS (SELECT * FROM (VALUES ('a', 0.9, 1.1), ('b', 1.2, 0.8)) AS v(metric, luma, chroma)) SELECT metric, c_mktsegment, round(sum(c_acctbal * luma + c_custkey * chroma), 2) AS score FROM customer, t GROUP BY metric, c_mktsegment")
def _(spark, sf):
    """Constants by metric: two rows, unrolled into one aggregate."""
    c = planes.table(spark, sf, "customer").groupBy("c_mktsegment").agg(*[F.sum(F.col("c_acctbal") * a + F.col("c_custkey") * b).alias(n) for n, a, b in (("a", 0.9, 1.1), ("b", 1.2, 0.8))])
    return c.select("c_mktsegment", F.expr("stack(2, 'a', a, 'b', b) AS (metric, score)")).select("metric", "c_mktsegment", F.round("score", 2).alias("score"))
