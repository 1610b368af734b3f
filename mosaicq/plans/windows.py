"""Queries of stencils, predictors, filters and prefix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.functions import color
from mosaicq.operators.cost import shannon, token_cost
from mosaicq.operators.groups import by_groups, column, lengths
from mosaicq.operators.predict import neighbours, predictors, properties, residual_tokens, tap
from mosaicq.plans.catalog import query
from mosaicq.plans.sql import LONG, RGB, SIGNAL, YCC, gradient_residual
from mosaicq.plans.sql import neighbours as nb_sql
from mosaicq.sources import planes


def ycc_pixels(spark, sf):
    """(img, i, x, y, c0, c1, c2): a row a pixel."""
    px = planes.rgb8(spark, sf)
    return px.select("img", "i", "x", "y", *[v.alias(f"c{k}") for k, v in enumerate(color.ycocg(F.col("r"), F.col("g"), F.col("b")))])


def ycc(spark, sf):
    return planes.channels(ycc_pixels(spark, sf), "c0", "c1", "c2")


def raw_channels(spark, sf):
    return planes.channels(planes.rgb8(spark, sf), "r", "g", "b")


_NB = f"{YCC}, {nb_sql('ych')}"
_TAPS = ("w", "n", "nw", "ne", "ww", "nn", "nee")


@query("win01_neighbours", f"WITH {_NB} SELECT img, c, i, v, {', '.join(_TAPS)} FROM nb")
def _(spark, sf):
    return neighbours(ycc(spark, sf)).select("img", "c", "i", "v", *_TAPS)


_PRED = {
    0: "0", 1: "w", 2: "n", 3: "(w + n) // 2", 4: "CASE WHEN abs(n - nw) < abs(w - nw) THEN w ELSE n END", 5: "least(greatest(w + n - nw, least(w, n)), greatest(w, n))",
    7: "ne", 8: "nw", 9: "ww", 10: "(w + nw) // 2", 11: "(nw + n) // 2", 12: "(n + ne) // 2", 13: "(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8) // 16",
}


@query("win02_predictors", f"WITH {_NB} SELECT img, c, i, {', '.join(f'{e} AS p{k}' for k, e in _PRED.items())} FROM nb")
def _(spark, sf):
    return neighbours(ycc(spark, sf)).select("img", "c", "i", *[p.alias(f"p{k}") for k, p in predictors().items()])


_PROPS = {0: "c", 1: "0", 2: "y", 3: "x", 4: "abs(n)", 5: "abs(w)", 6: "n", 7: "w", 8: "w - CASE WHEN x > 0 THEN lag(w + n - nw) OVER (PARTITION BY img, c ORDER BY i) ELSE 0 END", 9: "w + n - nw", 10: "w - nw", 11: "nw - n", 12: "n - ne", 13: "n - nn", 14: "w - ww"}


@query("win04_tree_properties", f"WITH {_NB} SELECT img, c, i, {', '.join(f'{e} AS q{k}' for k, e in _PROPS.items())} FROM nb")
def _(spark, sf):
    return neighbours(ycc(spark, sf)).select("img", "c", "i", *[p.alias(f"q{k}") for k, p in properties().items()])


@query("win05_reference_properties", f"""WITH {_NB}, g AS (SELECT img, c, i, v, v - least(greatest(w + n - nw, least(w, n)), greatest(w, n)) AS e FROM nb),
r AS (SELECT img, i, unnest(range(c + 1, 3)) AS c, c AS ref, v, e FROM g) SELECT img, c, i, ref, abs(v) AS size, v AS value, abs(e) AS error, e AS rest FROM r""")
def _(spark, sf):
    """Three channels of a pixel meet in one row, so earlier channels need no join."""
    g = neighbours(ycc(spark, sf)).withColumn("g", predictors()[5]).groupBy("img", "i").agg(*[F.max(F.when(F.col("c") == k, F.struct("v", "g"))).alias(f"k{k}") for k in range(3)])
    rows = [F.struct(F.lit(c).alias("c"), F.lit(r).alias("ref"), F.col(f"k{r}.v").alias("v"), F.col(f"k{r}.g").alias("g")) for c in range(3) for r in range(c)]
    out = g.select("img", "i", F.explode(F.array(*rows)).alias("t")).select("img", "i", "t.*")
    return out.select("img", "c", "i", "ref", F.abs("v").alias("size"), F.col("v").alias("value"), F.abs(F.col("v") - F.col("g")).alias("error"), (F.col("v") - F.col("g")).alias("rest"))


@query("join05_earlier_channels", f"WITH {YCC} SELECT a.img, a.c, b.c AS ref, count(*) AS n, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS apart, CAST(sum(a.v * b.v) AS BIGINT) AS product FROM ych a JOIN ych b ON a.img = b.img AND a.x = b.x AND a.y = b.y AND b.c < a.c GROUP BY a.img, a.c, b.c")
def _(spark, sf):
    """Each channel beside those before it at the same place; a pixel's channels are one row, so nothing is joined."""
    wide = ycc(spark, sf).groupBy("img", "x", "y").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"v{k}") for k in range(3)])
    rows = [F.struct(F.lit(c).alias("c"), F.lit(r).alias("ref"), F.col(f"v{c}").alias("a"), F.col(f"v{r}").alias("b")) for c in range(3) for r in range(c)]
    t = wide.select("img", F.explode(F.array(*rows)).alias("t")).select("img", "t.*")
    return t.groupBy("img", "c", "ref").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("apart"), F.sum(F.col("a") * F.col("b")).alias("product"))


@query("win06_activity_buckets", f"""WITH {_NB}, {gradient_residual()}, lagged AS (SELECT *, coalesce(CASE WHEN x > 0 THEN lag(abs(e)) OVER (PARTITION BY img, c ORDER BY i) END, 0) AS act FROM res),
t AS (SELECT * FROM (VALUES (8), (16), (24), (32), (48), (64), (96)) AS v(t)),
h AS (SELECT c, t, CASE WHEN act < t // 4 THEN 0 WHEN act < t THEN 1 ELSE 2 END AS bucket, token, count(*) AS n FROM lagged, t GROUP BY ALL),
e AS (SELECT c, t, bucket, CASE WHEN count(*) = 1 THEN 0 WHEN count(*) = 2 THEN sum(n) ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END AS bits FROM h GROUP BY ALL),
s AS (SELECT c, t, round(sum(bits), 4) AS bits FROM e GROUP BY ALL)
SELECT c, t AS threshold, bits FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY bits, t) AS k FROM s) WHERE k = 1""")
def _(spark, sf):
    """Each threshold's split is a column of the one histogram (activity, token), so the samples are counted once."""
    res = residual_tokens(ycc(spark, sf)).withColumn("act", F.coalesce(tap(-1, 0, F.abs(F.col("e"))), F.lit(0)))
    cells = res.groupBy("c", F.least("act", F.lit(96)).alias("act"), "token").agg(F.count("*").alias("n"))
    split = cells.withColumn("t", F.explode(F.array(*[F.lit(t) for t in (8, 16, 24, 32, 48, 64, 96)])))
    bucket = F.when(F.col("act") < F.expr("t div 4"), 0).when(F.col("act") < F.col("t"), 1).otherwise(2)
    h = split.groupBy("c", "t", bucket.alias("bucket"), "token").agg(F.sum("n").alias("n"))
    cost = h.groupBy("c", "t", "bucket").agg(shannon().alias("bits")).groupBy("c", "t").agg(F.round(F.sum("bits"), 4).alias("bits"))
    return cost.groupBy("c").agg(F.min(F.struct("bits", "t")).alias("b")).select("c", F.col("b.t").alias("threshold"), F.col("b.bits").alias("bits"))


# squeeze: pairs of a row become average and residual -----------------------------------------------------------------


def pair_average():
    """Of a sample v and its partner b; without one, v itself."""
    return F.when(F.col("b").isNull(), F.col("v")).otherwise(F.shiftright(F.col("v") + F.col("b") + (F.col("v") > F.col("b")).cast("int"), 1))


def squeeze_rows(px):
    """(img, c, y, pair, avg, diff): pairs of row neighbours; a sample without partner is its own average."""
    row = W.partitionBy("img", "c", "y").orderBy("x")
    pair = px.withColumn("b", F.lead("v").over(row)).filter("x % 2 = 0").withColumn("pair", F.expr("x div 2"))
    return pair.select("img", "c", "y", "pair", pair_average().alias("avg"), (F.col("v") - F.col("b")).alias("diff"))


@query("win07_squeeze_pairs", f"""WITH {YCC}, p AS (SELECT img, c, y, x, v, lead(v) OVER (PARTITION BY img, c, y ORDER BY x) AS b FROM ych)
SELECT img, c, y, x // 2 AS pair, CASE WHEN b IS NULL THEN v ELSE (v + b + (v > b)::INT) >> 1 END AS avg, v - b AS diff FROM p WHERE x % 2 = 0""")
def _(spark, sf):
    return squeeze_rows(ycc(spark, sf))


@query("win08_squeeze_levels", f"""WITH RECURSIVE {YCC}, lv AS (
  SELECT 0 AS level, img, c, y, x, v FROM ych
  UNION ALL
  SELECT level + 1, img, c, y, x // 2, CASE WHEN b IS NULL THEN v ELSE (v + b + (v > b)::INT) >> 1 END FROM (SELECT *, lead(v) OVER (PARTITION BY level, img, c, y ORDER BY x) AS b FROM lv WHERE level < 3) WHERE x % 2 = 0)
SELECT level, c, count(*) AS samples, sum(v) AS total, sum(abs(v)) AS size FROM lv GROUP BY level, c""")
def _(spark, sf):
    level, out = ycc(spark, sf).select("img", "c", "y", "x", "v"), []
    for k in range(4):
        out.append(level.groupBy("c").agg(F.count("*").alias("samples"), F.sum("v").alias("total"), F.sum(F.abs("v")).alias("size")).withColumn("level", F.lit(k)))
        level = squeeze_rows(level).select("img", "c", "y", F.col("pair").alias("x"), F.col("avg").alias("v"))
    union = out[0]
    for o in out[1:]:
        union = union.unionByName(o)
    return union


@query("win09_haar_cells", f"""WITH {LONG}, q AS (SELECT img, c, x // 2 AS bx, y // 2 AS bv, max(CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN v END) AS a, max(CASE WHEN x % 2 = 1 AND y % 2 = 0 THEN v END) AS b,
  max(CASE WHEN x % 2 = 0 AND y % 2 = 1 THEN v END) AS d, max(CASE WHEN x % 2 = 1 AND y % 2 = 1 THEN v END) AS e, count(*) AS n FROM ch GROUP BY ALL)
SELECT img, c, bx, bv, CAST(round((a + b + d + e) / 4.0) AS BIGINT) AS low, CASE WHEN abs(a - b + d - e) < 8 THEN 0 ELSE a - b + d - e END AS h, CASE WHEN abs(a + b - d - e) < 8 THEN 0 ELSE a + b - d - e END AS w, CASE WHEN abs(a - b - d + e) < 8 THEN 0 ELSE a - b - d + e END AS d2 FROM q WHERE n = 4""")
def _(spark, sf):
    cell = raw_channels(spark, sf).groupBy("img", "c", F.expr("x div 2").alias("bx"), F.expr("y div 2").alias("bv"))
    at = lambda dx, dy: F.max(F.when((F.col("x") % 2 == dx) & (F.col("y") % 2 == dy), F.col("v")))
    q = cell.agg(at(0, 0).alias("a"), at(1, 0).alias("b"), at(0, 1).alias("d"), at(1, 1).alias("e"), F.count("*").alias("n")).filter("n = 4")
    dead = lambda v: F.when(F.abs(v) < 8, 0).otherwise(v)
    a, b, d, e = (F.col(k) for k in "abde")
    return q.select("img", "c", "bx", "bv", F.round((a + b + d + e) / 4.0).cast("long").alias("low"), dead(a - b + d - e).alias("h"), dead(a + b - d - e).alias("w"), dead(a - b - d + e).alias("d2"))


# convolutions with mirrored edges ----------------------------------------------------------------------------------


def _mirrored_sql(radius: int) -> str:
    """ch with every tap of a square stencil; what lies outside is mirrored, the edge repeated; a short last row repeats its last sample."""
    return f"""{LONG}, long AS (SELECT img, c, y, count(*) AS len FROM ch GROUP BY ALL), high AS (SELECT img, c, max(y) + 1 AS m FROM ch GROUP BY ALL),
off AS (SELECT dx, dy FROM range(-{radius}, {radius + 1}) AS a(dx), range(-{radius}, {radius + 1}) AS b(dy)),
far AS (SELECT f.img, f.c, f.i, f.x, f.y, f.v, dx, dy, CASE WHEN f.x + dx < 0 THEN -1 - (f.x + dx) WHEN f.x + dx > 31 THEN 63 - (f.x + dx) ELSE f.x + dx END AS tx,
  CASE WHEN f.y + dy < 0 THEN least(-1 - (f.y + dy), m - 1) WHEN f.y + dy >= m THEN greatest(2 * m - 1 - (f.y + dy), 0) ELSE f.y + dy END AS ty FROM ch f JOIN high USING (img, c), off),
taps AS (SELECT far.* EXCLUDE (tx), least(tx, len - 1) AS tx FROM far JOIN long ON long.img = far.img AND long.c = far.c AND long.y = far.ty)"""


def stencil(spark, sf, radius: int, run, schema: str):
    """(img, c, x, y, schema) of every sample: run(taps, v) gives the columns of schema, taps being for each place of a square stencil in raster order
    the samples there of all of a batch's samples, channel by channel; what lies outside is mirrored, a null counts as nothing."""

    def each(px: pa.Table, starts: np.ndarray) -> dict:
        i, size = column(px, "i"), lengths(px, starts)
        base, end, rows = (np.repeat(a, size) for a in (starts, starts + size, -(-size // planes.WIDTH)))
        x, y = i % planes.WIDTH, i // planes.WIDTH
        v = np.stack([px[c].combine_chunks().fill_null(0).to_numpy() for c in "rgb"])
        null = np.stack([px[c].is_null().to_numpy() for c in "rgb"]) if any(px[c].null_count for c in "rgb") else None

        def places():
            for dy in range(-radius, radius + 1):
                ty = y + dy
                ty = np.where(ty < 0, np.minimum(-1 - ty, rows - 1), np.where(ty >= rows, np.maximum(2 * rows - 1 - ty, 0), ty))
                for dx in range(-radius, radius + 1):
                    tx = x + dx
                    tx = np.where(tx < 0, -1 - tx, np.where(tx >= planes.WIDTH, 2 * planes.WIDTH - 1 - tx, tx))
                    yield np.minimum(base + ty * planes.WIDTH + tx, end - 1)  # a short last row repeats its last sample

        none = None if null is None else np.logical_and.reduce([null[:, at] for at in places()]).reshape(-1)
        found = run((v[:, at] for at in places()), v)
        out = {n: pa.array(a.reshape(-1), mask=none) for n, a in found.items()}
        if "v" in out:
            out["v"] = pa.array(v.reshape(-1), mask=None if null is None else null.reshape(-1))
        return {"img": pa.chunked_array([px["img"].combine_chunks()] * 3), "c": np.repeat(np.arange(3, dtype=np.int32), len(i)), "x": np.tile(x, 3), "y": np.tile(y, 3), **out}

    return by_groups(planes.rgb8(spark, sf).select("img", "i", "r", "g", "b"), ["img"], "i", each, f"img long, c int, x long, y long, {schema}")


def convolve(spark, sf, kernel: list[list[float]]):
    flat = [float(k) for row in kernel for k in row]

    def run(taps, v: np.ndarray) -> dict:
        out = np.zeros(v.shape)
        for k, t in zip(flat, taps, strict=True):
            out += t * k
        return {"v": v, "out": out}

    return stencil(spark, sf, len(kernel) // 2, run, "v long, out double")


# Fixed values of the sharpening kernel: centre 1, then by distance.
_G = {"r": -0.0949581567, "d": -0.0410317251, "R": 0.0137100048, "L": 0.0065102061, "D": -0.0014789063}
_NORM = 1 / (1 + 4 * (_G["r"] + _G["d"] + _G["R"] + _G["D"] + 2 * _G["L"]))
_BY = {(0, 0): 1.0, (0, 1): _G["r"], (1, 1): _G["d"], (0, 2): _G["R"], (1, 2): _G["L"], (2, 2): _G["D"]}
SHARPEN = [[_BY[tuple(sorted((abs(dx), abs(dy))))] * _NORM for dx in range(-2, 3)] for dy in range(-2, 3)]
SMOOTH = [[0.06, 0.115, 0.06], [0.115, 0.3, 0.115], [0.06, 0.115, 0.06]]


def _convolution_sql(kernel: list[list[float]]) -> str:
    r = len(kernel) // 2
    values = ", ".join(f"({dx - r}, {dy - r}, {k!r})" for dy, row in enumerate(kernel) for dx, k in enumerate(row))
    return f"""WITH {_mirrored_sql(r)}, k AS (SELECT * FROM (VALUES {values}) AS t(dx, dy, k))
SELECT t.img, t.c, t.x, t.y, t.v, round(sum(CAST(s.v AS DOUBLE) * k.k), 6) AS out FROM taps t JOIN k USING (dx, dy) JOIN ch s ON s.img = t.img AND s.c = t.c AND s.x = t.tx AND s.y = t.ty GROUP BY ALL"""


@query("win10_sharpen", _convolution_sql(SHARPEN))
def _(spark, sf):
    return convolve(spark, sf, SHARPEN).withColumn("out", F.round("out", 6))


@query("win11_smooth", _convolution_sql(SMOOTH))
def _(spark, sf):
    return convolve(spark, sf, SMOOTH).withColumn("out", F.round("out", 6))


@query("win13_box_moments", f"""WITH {_mirrored_sql(2)} SELECT t.img, t.c, t.x, t.y, CAST(sum(s.v) AS BIGINT) AS total, CAST(sum(s.v * s.v) AS BIGINT) AS square, CAST(sum(s.v * (s.v // 6 * 6 + 3)) AS BIGINT) AS mixed
FROM taps t JOIN ch s ON s.img = t.img AND s.c = t.c AND s.x = t.tx AND s.y = t.ty GROUP BY ALL""")
def _(spark, sf):
    """Sums of a box's samples, of their squares, and of their products with the same box of a coarser plane."""

    def run(taps, v: np.ndarray) -> dict:
        total, square, mixed = (np.zeros_like(v) for _ in range(3))
        for t in taps:
            total += t
            square += t * t
            mixed += t * (t - np.fmod(t, 6) + 3)
        return {"total": total, "square": square, "mixed": mixed}

    return stencil(spark, sf, 2, run, "total long, square long, mixed long")


@query("win14_half_resolution", f"WITH {LONG} SELECT img, c, x // 2 AS x, y // 2 AS y, round(avg(v), 6) AS v FROM ch GROUP BY img, c, x // 2, y // 2")
def _(spark, sf):
    return raw_channels(spark, sf).groupBy("img", "c", F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y")).agg(F.round(F.avg("v"), 6).alias("v"))


def summed_area(px):
    """px with s: the sum of all samples not below and not right of each."""
    row = px.withColumn("p", F.sum("v").over(W.partitionBy("img", "c", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    return row.withColumn("s", F.sum("p").over(W.partitionBy("img", "c", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0))).drop("p")


@query("win15_summed_area", f"""WITH {LONG}, p AS (SELECT *, sum(v) OVER (PARTITION BY img, c, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS p FROM ch)
SELECT img, c, x, y, CAST(sum(p) OVER (PARTITION BY img, c, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM p""")
def _(spark, sf):
    return summed_area(raw_channels(spark, sf)).select("img", "c", "x", "y", "s")


_ROW7, _COL7 = "PARTITION BY img, c, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING", "PARTITION BY img, c, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"


@query("win16_top_hat", f"""WITH {LONG}, a AS (SELECT *, min(v) OVER ({_ROW7}) AS m FROM ch), b AS (SELECT *, min(m) OVER ({_COL7}) AS lo FROM a), d AS (SELECT *, max(lo) OVER ({_ROW7}) AS m2 FROM b)
SELECT img, c, x, y, v - max(m2) OVER ({_COL7}) AS peak FROM d""")
def _(spark, sf):
    row, col = (W.partitionBy("img", "c", a).orderBy(b).rowsBetween(-3, 3) for a, b in (("y", "x"), ("x", "y")))
    out = raw_channels(spark, sf)
    for fn, w in ((F.min, row), (F.min, col), (F.max, row), (F.max, col)):
        out = out.withColumn("m", fn("v" if "m" not in out.columns else "m").over(w))
    return out.select("img", "c", "x", "y", (F.col("v") - F.col("m")).alias("peak"))


_EIGHT = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def _tap_sql(dx: int, dy: int) -> str:
    back = -(dx + dy * 32)
    fn = f"lag(v, {back})" if back >= 0 else f"lead(v, {-back})"
    when = f"x >= {-dx}" if dx < 0 else f"x < {32 - dx}" if dx > 0 else "true"
    return f"CASE WHEN {when} THEN {fn} OVER (PARTITION BY img, c ORDER BY i) END"


@query("win17_local_maxima", f"""WITH {LONG}, t AS (SELECT *, {', '.join(f'{_tap_sql(*o)} AS t{k}' for k, o in enumerate(_EIGHT))} FROM ch)
SELECT img, c, x, y, v FROM t WHERE {' AND '.join(f'coalesce(v {">=" if k < 4 else ">"} t{k}, true)' for k in range(8))}""")
def _(spark, sf):
    """A plateau's first sample in raster order wins: later neighbours must be smaller, earlier ones not larger."""
    t = raw_channels(spark, sf).select("*", *[tap(*o).alias(f"t{k}") for k, o in enumerate(_EIGHT)])
    for k in range(8):
        t = t.filter(F.coalesce(F.col("v") >= F.col(f"t{k}") if k < 4 else F.col("v") > F.col(f"t{k}"), F.lit(True)))
    return t.select("img", "c", "x", "y", "v")


@query("win18_ridge_strength", f"""WITH {LONG}, t AS (SELECT *, {', '.join(f'coalesce({_tap_sql(*o)}, v) AS t{k}' for k, o in enumerate(_EIGHT))} FROM ch),
h AS (SELECT img, c, x, y, t3 + t4 - 2 * v AS xx, t1 + t6 - 2 * v AS yy, (t0 + t7 - t2 - t5) / 4.0 AS xy FROM t)
SELECT img, c, x, y, round((xx + yy) / 2.0 + sqrt((xx - yy) * (xx - yy) / 4.0 + xy * xy), 6) AS most, round((xx + yy) / 2.0 - sqrt((xx - yy) * (xx - yy) / 4.0 + xy * xy), 6) AS least FROM h""")
def _(spark, sf):
    """Eigenvalues of the second derivatives; missing neighbours repeat the pixel."""
    t = raw_channels(spark, sf).select("img", "c", "x", "y", "v", "i", *[F.coalesce(tap(*o), F.col("v")).alias(f"t{k}") for k, o in enumerate(_EIGHT)])
    h = t.select("img", "c", "x", "y", F.expr("t3 + t4 - 2 * v").alias("xx"), F.expr("t1 + t6 - 2 * v").alias("yy"), F.expr("(t0 + t7 - t2 - t5) / 4D").alias("xy"))
    mid, root = F.expr("(xx + yy) / 2D"), F.expr("sqrt((xx - yy) * (xx - yy) / 4D + xy * xy)")
    return h.select("img", "c", "x", "y", F.round(mid + root, 6).alias("most"), F.round(mid - root, 6).alias("least"))


@query("win20_masking_field", f"""WITH {LONG}, t AS (SELECT img, x, y, v / 255.0 AS v, coalesce({_tap_sql(-1, 0)}, v) / 255.0 AS l, coalesce({_tap_sql(1, 0)}, v) / 255.0 AS r, coalesce({_tap_sql(0, -1)}, v) / 255.0 AS u, coalesce({_tap_sql(0, 1)}, v) / 255.0 AS d FROM ch WHERE c = 1),
p AS (SELECT *, least(0.2, pow((v + 0.019) * (v - (l + r + u + d) / 4), 2)) AS e FROM t)
SELECT img, x // 4 AS bx, y // 4 AS bv, round(avg(sqrt(e)), 6) AS mask FROM p GROUP BY img, x // 4, y // 4""")
def _(spark, sf):
    ch = raw_channels(spark, sf).filter("c = 1")
    near = [F.coalesce(tap(dx, dy), F.col("v")) / 255.0 for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    t = ch.select("img", "x", "y", "i", "c", "v", (F.col("v") / 255.0).alias("u"), ((near[0] + near[1] + near[2] + near[3]) / 4).alias("m"))
    e = F.least(F.lit(0.2), F.pow((F.col("u") + 0.019) * (F.col("u") - F.col("m")), F.lit(2.0)))
    return t.select("img", "x", "y", e.alias("e")).groupBy("img", F.expr("x div 4").alias("bx"), F.expr("y div 4").alias("bv")).agg(F.round(F.avg(F.sqrt("e")), 6).alias("mask"))


_S9, _C9 = "PARTITION BY img, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING", "PARTITION BY img, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING"


@query("win22_alpha_fringe", f"""WITH {RGB}, f AS (SELECT img, x, y, b // 31 AS level, CASE WHEN b // 31 BETWEEN 1 AND 4 THEN b // 31 ELSE 0 END AS faint FROM rgb),
h AS (SELECT *, sum(faint) OVER ({_S9}) AS s, count(*) OVER ({_S9}) AS n FROM f), w AS (SELECT *, sum(s) OVER ({_C9}) AS s2, sum(n) OVER ({_C9}) AS n2 FROM h)
SELECT img, x, y, level, level BETWEEN 1 AND 4 AND s2 / n2 <= 1.5 AS cleared FROM w""")
def _(spark, sf):
    level = F.expr("b div 31")
    f = planes.rgb8(spark, sf).select("img", "x", "y", level.alias("level")).withColumn("faint", F.when(F.col("level").between(1, 4), F.col("level")).otherwise(0))
    row, col = (W.partitionBy("img", a).orderBy(b).rowsBetween(-4, 4) for a, b in (("y", "x"), ("x", "y")))
    h = f.withColumn("s", F.sum("faint").over(row)).withColumn("n", F.count("*").over(row))
    w = h.withColumn("s2", F.sum("s").over(col)).withColumn("n2", F.sum("n").over(col))
    return w.select("img", "x", "y", "level", (F.col("level").between(1, 4) & (F.col("s2") / F.col("n2") <= 1.5)).alias("cleared"))


@query("win24_equal_spans", f"""WITH {SIGNAL}, q AS (SELECT user_id, t, v // 5000 AS v FROM sig), s AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS pv FROM q))
SELECT user_id, CAST(run AS BIGINT) AS run, min(t) AS start, v, count(*) AS n, CASE WHEN count(*) - 1 >= 3 THEN count(*) - 1 ELSE 0 END AS copied FROM s GROUP BY user_id, run, v""")
def _(spark, sf):
    sig = planes.signal(spark, sf).withColumn("v", F.expr("v div 5000"))
    w = W.partitionBy("user_id").orderBy("t")
    s = sig.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("long"), F.lit(1)))
    runs = s.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("user_id", "run", "v").agg(F.min("t").alias("start"), F.count("*").alias("n"))
    return runs.select("user_id", "run", "start", "v", "n", F.when(F.col("n") - 1 >= 3, F.col("n") - 1).otherwise(0).alias("copied"))


@query("win25_gradient_scores", f"""WITH {LONG}, t AS (SELECT *, {', '.join(f'coalesce({_tap_sql(*o)}, v) AS t{k}' for k, o in enumerate(_EIGHT))} FROM ch)
SELECT img, c, x, y, t0 + t1 + t2 + t3 + t4 + t5 + t6 + t7 AS around, CASE WHEN abs(8 * v - (t0 + t1 + t2 + t3 + t4 + t5 + t6 + t7)) < 16 THEN (t0 + t1 + t2 + t3 + t4 + t5 + t6 + t7) // 8 ELSE v END AS flat FROM t""")
def _(spark, sf):
    t = raw_channels(spark, sf).select("img", "c", "x", "y", "v", "i", *[F.coalesce(tap(*o), F.col("v")).alias(f"t{k}") for k, o in enumerate(_EIGHT)])
    t = t.withColumn("around", F.expr("t0 + t1 + t2 + t3 + t4 + t5 + t6 + t7"))
    return t.select("img", "c", "x", "y", "around", F.when(F.abs(F.col("v") * 8 - F.col("around")) < 16, F.expr("around div 8")).otherwise(F.col("v")).alias("flat"))


_SLICE0 = f"""WITH {_NB}, {gradient_residual()}, h AS (SELECT c, token, count(*) AS n, sum(nbits) AS raw FROM res GROUP BY ALL)
SELECT c, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(raw) AS BIGINT) AS raw_bits, round(CASE WHEN count(*) = 1 THEN 0 WHEN count(*) = 2 THEN sum(n) ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END, 3) AS bits FROM h GROUP BY c"""


@query("ent19_lossless_size", _SLICE0)
def lossless_size(spark, sf):
    """The fast lossless estimate end to end: colour transform, prediction, tokens, histogram, bits per channel."""
    return token_cost(residual_tokens(ycc(spark, sf)), "c").withColumn("bits", F.round("bits", 3))
