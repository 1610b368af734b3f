"""Queries of histograms, entropy costs, palettes, co-occurrence and the choice between coded forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.functions import codes, color
from mosaicq.operators.cost import entropy, histogram, shannon, token_cost
from mosaicq.operators.predict import neighbours, predictors, residual_tokens, tap
from mosaicq.plans.catalog import query
from mosaicq.plans.sql import LETTERS, LONG, RGB, SIGNAL, YCC, gradient_residual
from mosaicq.plans.sql import neighbours as nb_sql
from mosaicq.plans.windows import _PRED, raw_channels, ycc
from mosaicq.sources import planes

_RES = f"{YCC}, {nb_sql('ych')}, {gradient_residual()}"
_BITS = "CASE WHEN count(*) = 1 THEN 0 WHEN count(*) = 2 THEN sum(n) ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END"
_ENT = "CASE WHEN count(*) = 1 THEN 0 ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END"


def residuals(spark, sf):
    return residual_tokens(ycc(spark, sf))


@query("agg01_symbol_histogram", f"WITH {_RES} SELECT c, token, count(*) AS n FROM res GROUP BY c, token")
def _(spark, sf):
    return histogram(residuals(spark, sf), "c")


@query("agg02_histogram_merge", f"""WITH {_RES}, h AS (SELECT c, token, count(*) AS n FROM res GROUP BY ALL), a AS (SELECT token, sum(n) AS n FROM h GROUP BY token), b AS (SELECT token, n FROM h WHERE c = 0)
SELECT a.token, CAST(a.n AS BIGINT) AS merged, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS rest FROM a LEFT JOIN b USING (token)""")
def _(spark, sf):
    """The sum of all channels' counts, and the same less channel 0's: both from one aggregate."""
    return histogram(residuals(spark, sf), "c").groupBy("token").agg(F.sum("n").alias("merged"), F.sum(F.when(F.col("c") != 0, F.col("n")).otherwise(0)).alias("rest"))


@query("agg03_shannon_bits", f"WITH {_RES}, h AS (SELECT img, c, token, count(*) AS n FROM res GROUP BY ALL) SELECT img, c, CAST(sum(n) AS BIGINT) AS samples, round({_BITS}, 4) AS bits FROM h GROUP BY img, c")
def _(spark, sf):
    return histogram(residuals(spark, sf), "img", "c").groupBy("img", "c").agg(F.sum("n").alias("samples"), F.round(shannon(), 4).alias("bits"))


@query("agg05_order0_entropy", f"WITH {LONG}, h AS (SELECT img, c, v, count(*) AS n FROM ch GROUP BY ALL) SELECT img, c, round({_ENT} / sum(n), 6) AS bits_a_sample FROM h GROUP BY img, c")
def _(spark, sf):
    return raw_channels(spark, sf).groupBy("img", "c", "v").agg(F.count("*").alias("n")).groupBy("img", "c").agg(F.round(entropy() / F.sum("n"), 6).alias("bits_a_sample"))


# A context is how many of these exceed the neighbours' range.
CUTOFFS = (0, 1, 3, 5, 7, 11, 15, 23, 31, 47, 63, 95, 127, 191, 255, 392, 500)
_RANGE = "least(greatest(w, n, nw) - least(w, n, nw), 500)"
_CTX = " + ".join(f"({k} > {_RANGE})::INT" for k in CUTOFFS)


@query("agg06_context_cost", f"""WITH {YCC}, {nb_sql('ych')}, {gradient_residual()}, k AS (SELECT nb.img, nb.c, nb.i, {_CTX} AS ctx FROM nb),
h AS (SELECT c, ctx, least(token, 63) AS token, count(*) AS n, sum(nbits) AS raw FROM res JOIN k USING (img, c, i) GROUP BY ALL),
e AS (SELECT c, ctx, {_ENT} AS bits, sum(raw) AS raw FROM h GROUP BY ALL) SELECT c, count(*) AS contexts, round(sum(bits), 3) AS bits, CAST(sum(raw) AS BIGINT) AS raw_bits FROM e GROUP BY c""")
def _(spark, sf):
    w, n, nw = F.col("w"), F.col("n"), F.col("nw")
    spread = F.least(F.greatest(w, n, nw) - F.least(w, n, nw), F.lit(500))
    ctx = sum(((F.lit(k) > spread).cast("int") for k in CUTOFFS[1:]), (F.lit(CUTOFFS[0]) > spread).cast("int"))
    nb = neighbours(ycc(spark, sf)).withColumn("z", codes.zigzag(F.col("v") - predictors()[5])).withColumn("ctx", ctx)
    h = nb.groupBy("c", "ctx", F.least(codes.hybrid_token(F.col("z")), F.lit(63)).alias("token")).agg(F.count("*").alias("n"), F.sum(codes.hybrid_bits(F.col("z"))).alias("raw"))
    e = h.groupBy("c", "ctx").agg(entropy().alias("bits"), F.sum("raw").alias("raw"))
    return e.groupBy("c").agg(F.count("*").alias("contexts"), F.round(F.sum("bits"), 3).alias("bits"), F.sum("raw").alias("raw_bits"))


_PRED_ROWS = " UNION ALL ".join(f"SELECT c, {k} AS predictor, v - ({e}) AS e FROM nb" for k, e in _PRED.items())
_PRED_COST = f"""{YCC}, {nb_sql('ych')}, pr AS ({_PRED_ROWS}), pz AS (SELECT c, predictor, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z FROM pr), pk AS (SELECT *, length(bin(z)) - 1 AS k FROM pz),
ph AS (SELECT c, predictor, CASE WHEN z < 16 THEN z ELSE 4 * k + ((z - (1::BIGINT << k::INT)) >> (k - 2)::INT) END AS token, count(*) AS n, sum(CASE WHEN z < 16 THEN 0 ELSE k - 2 END) AS raw FROM pk GROUP BY ALL),
pc AS (SELECT c, predictor, round({_BITS} + sum(raw), 3) AS bits FROM ph GROUP BY c, predictor)"""


def predictor_costs(spark, sf):
    """(c, predictor, bits): one pass counts every predictor's residuals, whose alphabet is bounded; only that is tokenised."""
    nb = neighbours(ycc(spark, sf))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("predictor"), codes.zigzag(F.col("v") - p).alias("z")) for k, p in predictors().items()]))
    z = nb.select("c", rows.alias("r")).groupBy("c", "r.predictor", "r.z").agg(F.count("*").alias("m"))
    h = z.groupBy("c", "predictor", codes.hybrid_token(F.col("z")).alias("token")).agg(F.sum("m").alias("n"), F.sum(F.col("m") * codes.hybrid_bits(F.col("z"))).alias("raw"))
    return h.groupBy("c", "predictor").agg(F.round(shannon() + F.sum("raw"), 3).alias("bits"))


@query("agg07_predictor_costs", f"WITH {_PRED_COST} SELECT * FROM pc")
def _(spark, sf):
    return predictor_costs(spark, sf)


@query("race01_best_predictor", f"WITH {_PRED_COST} SELECT c, predictor, bits FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY bits, predictor) AS k FROM pc) WHERE k = 1")
def _(spark, sf):
    """The cheapest predictor; the lower number wins ties."""
    best = predictor_costs(spark, sf).groupBy("c").agg(F.min(F.struct("bits", "predictor")).alias("b"))
    return best.select("c", "b.predictor", "b.bits")


# palettes -------------------------------------------------------------------------------------------------------------

_PAL = f"{RGB}, pal AS (SELECT img, r, g, b, count(*) AS n FROM rgb GROUP BY ALL)"


def palette(spark, sf):
    return planes.rgb8(spark, sf).groupBy("img", "r", "g", "b").agg(F.count("*").alias("n"))


@query("agg09_palette", f"WITH {_PAL} SELECT img, count(*) AS colors, CAST(max(n) AS BIGINT) AS most, count(*) <= 256 AS fits FROM pal GROUP BY img")
def _(spark, sf):
    return palette(spark, sf).groupBy("img").agg(F.count("*").alias("colors"), F.max("n").alias("most"), (F.count("*") <= 256).alias("fits"))


_INDEX = f"""{_PAL}, idx AS (SELECT img, r, g, b, row_number() OVER (PARTITION BY img ORDER BY 299 * r + 587 * g + 114 * b, r, g, b) - 1 AS k FROM pal)"""


def palette_index(spark, sf):
    order = W.partitionBy("img").orderBy(color.luma(F.col("r"), F.col("g"), F.col("b")), "r", "g", "b")
    return palette(spark, sf).select("img", "r", "g", "b", (F.row_number().over(order) - 1).cast("long").alias("k"))


def indexed(spark, sf):
    """(img, c, i, x, y, v): pixels as indices into their image's palette: a colour's index is its rank among those of its image, so nothing is joined."""
    px = planes.rgb8(spark, sf).filter("img is not null and r is not null and g is not null and b is not null")
    order = W.partitionBy("img").orderBy(color.luma(F.col("r"), F.col("g"), F.col("b")), "r", "g", "b")
    return px.select("img", F.lit(0).alias("c"), "i", "x", "y", (F.dense_rank().over(order) - 1).cast("long").alias("v"))


@query("join01_palette_lookup", f"WITH {_INDEX} SELECT img, i, k FROM rgb JOIN idx USING (img, r, g, b)")
def _(spark, sf):
    return indexed(spark, sf).select("img", "i", F.col("v").alias("k"))


_PLANE = f"{_INDEX}, pix AS (SELECT img, 0 AS c, i, x, y, k AS v FROM rgb JOIN idx USING (img, r, g, b))"


@query("agg08_index_cost", f"""WITH {_PLANE}, t AS (SELECT *, coalesce(CASE WHEN x > 0 THEN lag(v) OVER (PARTITION BY img ORDER BY i) END, 0) AS w, coalesce(lag(v, 32) OVER (PARTITION BY img ORDER BY i), 0) AS n FROM pix),
p AS (SELECT img, 'left' AS kind, v - w AS e FROM t UNION ALL SELECT img, 'top', v - n FROM t UNION ALL SELECT img, 'value', v FROM t),
h AS (SELECT img, kind, e, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT img, kind, {_ENT} AS bits FROM h GROUP BY img, kind) SELECT img, round(min(bits), 4) AS bits FROM s GROUP BY img""")
def _(spark, sf):
    """Outside the plane the index is 0; the cheapest way to code the whole plane counts."""
    px = indexed(spark, sf)
    w, n = F.coalesce(tap(-1, 0), F.lit(0)), F.coalesce(tap(0, -1), F.lit(0))
    t = px.select("img", "v", w.alias("w"), n.alias("n"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("e")) for k, e in (("left", F.col("v") - F.col("w")), ("top", F.col("v") - F.col("n")), ("value", F.col("v")))]))
    h = t.select("img", kinds.alias("p")).groupBy("img", "p.kind", "p.e").agg(F.count("*").alias("n"))
    return h.groupBy("img", "kind").agg(entropy().alias("bits")).groupBy("img").agg(F.round(F.min("bits"), 4).alias("bits"))


_ADJ = f"""{_PLANE}, pr AS (SELECT img, v AS a, CASE WHEN x > 0 THEN lag(v) OVER (PARTITION BY img ORDER BY i) END AS b FROM pix UNION ALL SELECT img, v, lag(v, 32) OVER (PARTITION BY img ORDER BY i) FROM pix),
co AS (SELECT img, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM pr WHERE a <> b GROUP BY ALL)"""


def cooccurrence(spark, sf):
    taps = indexed(spark, sf).select("img", F.col("v").alias("a"), F.array(tap(-1, 0), tap(0, -1)).alias("near"))
    t = taps.select("img", "a", F.explode("near").alias("b")).filter("a <> b")
    return t.groupBy("img", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


@query("agg10_cooccurrence", f"WITH {_ADJ} SELECT img, a, b, n FROM co")
def _(spark, sf):
    return cooccurrence(spark, sf)


@query("join10_touching_colors", f"WITH {_ADJ}, two AS (SELECT img, a, b FROM co UNION ALL SELECT img, b, a FROM co) SELECT img, a AS color, count(*) AS touches FROM two GROUP BY img, a")
def _(spark, sf):
    co = cooccurrence(spark, sf)
    return co.select("img", F.explode(F.array("a", "b")).alias("color")).groupBy("img", "color").agg(F.count("*").alias("touches"))


@query("agg11_color_modes", f"""WITH {RGB}, cell AS (SELECT img, r // 16 AS qr, g // 16 AS qg, b // 16 AS qb, count(*) AS n, round(avg(r)) AS mr, round(avg(g)) AS mg, round(avg(b)) AS mb FROM rgb GROUP BY ALL)
SELECT img, k, n, CAST(mr AS BIGINT) AS red, CAST(mg AS BIGINT) AS green, CAST(mb AS BIGINT) AS blue FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, qr, qg, qb) AS k FROM cell) WHERE k <= 24""")
def _(spark, sf):
    cell = planes.rgb8(spark, sf).groupBy("img", *[F.expr(f"{c} div 16").alias(f"q{c}") for c in "rgb"]).agg(F.count("*").alias("n"), *[F.round(F.avg(c)).cast("long").alias(o) for c, o in zip("rgb", ("red", "green", "blue"), strict=True)])
    k = F.row_number().over(W.partitionBy("img").orderBy(F.desc("n"), "qr", "qg", "qb"))
    return cell.withColumn("k", k).filter("k <= 24").select("img", "k", "n", "red", "green", "blue")


@query("agg18_edge_model", f"""WITH {LONG}, d AS (SELECT img, x, y, max(abs(v - l)) AS dl, max(abs(v - u)) AS du FROM (SELECT img, c, x, y, v, CASE WHEN x > 0 THEN lag(v) OVER (PARTITION BY img, c ORDER BY i) END AS l, lag(v, 32) OVER (PARTITION BY img, c ORDER BY i) AS u FROM ch) GROUP BY img, x, y),
e AS (SELECT img, dl AS d FROM d WHERE dl IS NOT NULL UNION ALL SELECT img, du FROM d WHERE du IS NOT NULL), h AS (SELECT img, d, count(*) AS n FROM e GROUP BY ALL)
SELECT img, CAST(sum(n) AS BIGINT) AS edges, round(1.16 * sum(n * log2(1 + d / (4 * 2.0))) / 8 * pow(2.0, -0.41), 4) AS bytes FROM h GROUP BY img""")
def _(spark, sf):
    t = raw_channels(spark, sf).select("img", "c", "i", "x", "y", F.abs(F.col("v") - tap(-1, 0)).alias("l"), F.abs(F.col("v") - tap(0, -1)).alias("u"))
    d = t.groupBy("img", "i").agg(F.max("l").alias("l"), F.max("u").alias("u")).select("img", F.explode(F.array("l", "u")).alias("d")).filter("d is not null")
    h = d.groupBy("img", "d").agg(F.count("*").alias("n"))
    bits = F.sum(F.col("n") * F.log2(F.col("d") / 8.0 + 1))
    return h.groupBy("img").agg(F.sum("n").alias("edges"), F.round(bits * 1.16 / 8 * 2.0**-0.41, 4).alias("bytes"))


@query("agg19_autocorrelation", f"""WITH {LONG}, g AS (SELECT img, x, y, v FROM ch WHERE c = 0 AND y % 4 = 0)
SELECT a.img, k AS lag, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * CAST(sum(b.v * b.v) AS DOUBLE)), 6) AS correlation FROM range(1, 13) AS t(k), g a JOIN g b ON a.img = b.img AND a.y = b.y AND b.x = a.x + k GROUP BY a.img, k""")
def _(spark, sf):
    """All lags come from one ordered window; no self-join."""
    g = raw_channels(spark, sf).filter("c = 0 and y % 4 = 0")
    row = W.partitionBy("img", "y").orderBy("x")
    ahead = g.select("img", "v", F.array(*[F.lead("v", k).over(row) for k in range(1, 13)]).alias("ahead"))
    sums = ahead.select("img", "v", F.posexplode("ahead").alias("k", "b")).filter("b is not null")
    s = sums.groupBy("img", (F.col("k") + 1).alias("lag")).agg(F.sum(F.col("v") * F.col("b")).alias("ab"), F.sum(F.col("v") * F.col("v")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select("img", "lag", F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb").cast("double")), 6).alias("correlation"))


@query("agg13_site_variance", f"WITH {LONG} SELECT img, c, x // 8 AS bx, y // 8 AS bv, round(var_pop(v), 6) AS variance FROM ch GROUP BY img, c, x // 8, y // 8")
def _(spark, sf):
    return raw_channels(spark, sf).groupBy("img", "c", F.expr("x div 8").alias("bx"), F.expr("y div 8").alias("bv")).agg(F.round(F.var_pop("v"), 6).alias("variance"))


# The share of the largest sample falls with distance by 0.56391 from 1.54138 on.
@query("agg14_quant_aggregate", f"""WITH {RGB}, s AS (SELECT img, x // 8 AS bx, y // 8 AS bv, max(g) AS m, avg(g) AS a, count(*) AS n FROM rgb GROUP BY ALL), m AS (SELECT greatest(0, 1 - 0.56391 * greatest(0, 2.2 - 1.54138)) AS k)
SELECT img, bx, bv, CAST(least(greatest(CASE WHEN n < 4 THEN m ELSE floor(k * m + (1 - k) * a + 0.5) END, 1), 255) AS BIGINT) AS q FROM s, m""")
def _(spark, sf):
    k = max(0.0, 1 - 0.56391 * max(0.0, 2.2 - 1.54138))
    s = planes.rgb8(spark, sf).groupBy("img", F.expr("x div 8").alias("bx"), F.expr("y div 8").alias("bv")).agg(F.max("g").alias("m"), F.avg("g").alias("a"), F.count("*").alias("n"))
    q = F.when(F.col("n") < 4, F.col("m")).otherwise(F.floor(F.col("m") * k + F.col("a") * (1 - k) + 0.5))
    return s.select("img", "bx", "bv", F.least(F.greatest(q, F.lit(1)), F.lit(255)).cast("long").alias("q"))


@query("agg17_haar_detail", f"""WITH {LONG}, c1 AS (SELECT img, x // 2 AS x, y // 2 AS y, avg(v) AS m, (abs(max(CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN v END) - max(CASE WHEN x % 2 = 1 AND y % 2 = 0 THEN v END)) + abs(max(CASE WHEN x % 2 = 0 AND y % 2 = 1 THEN v END) - max(CASE WHEN x % 2 = 1 AND y % 2 = 1 THEN v END))
 + 0.5 * abs(sum(CASE WHEN y % 2 = 0 THEN v ELSE -v END))) / 3 AS d, count(*) AS n FROM ch WHERE c = 0 GROUP BY img, x // 2, y // 2)
SELECT img, round(avg(d), 6) AS detail FROM c1 WHERE n = 4 GROUP BY img""")
def _(spark, sf):
    at = lambda dx, dy: F.max(F.when((F.col("x") % 2 == dx) & (F.col("y") % 2 == dy), F.col("v")))
    c = raw_channels(spark, sf).filter("c = 0").groupBy("img", F.expr("x div 2").alias("bx"), F.expr("y div 2").alias("bv")).agg(at(0, 0).alias("a"), at(1, 0).alias("b"), at(0, 1).alias("d"), at(1, 1).alias("e"), F.count("*").alias("n"))
    detail = F.expr("(abs(a - b) + abs(d - e) + 0.5D * abs(a + b - d - e)) / 3D")
    return c.filter("n = 4").groupBy("img").agg(F.round(F.avg(detail), 6).alias("detail"))


@query("agg21_noise_cutoffs", f"""WITH {LONG}, p AS (SELECT img, x // 8 AS bx, y // 8 AS bv, avg(v) AS m, stddev_pop(v) AS s FROM ch WHERE c = 1 GROUP BY ALL), q AS (SELECT CAST(floor(m / 32) AS BIGINT) AS bin, round(s, 6) AS s FROM p)
SELECT bin, n, list_sort(l)[n // 2 + 1] AS median FROM (SELECT bin, count(*) AS n, list(s) AS l FROM q GROUP BY bin)""")
def _(spark, sf):
    """The upper median: element n div 2 of each bin's sorted scores, found by rank, no bin is gathered."""
    p = raw_channels(spark, sf).filter("c = 1").groupBy("img", F.expr("x div 8").alias("bx"), F.expr("y div 8").alias("bv")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    q = p.select(F.floor(F.col("m") / 32).alias("bin"), F.round("s", 6).alias("s")).groupBy("bin", "s").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy("bin").orderBy("s").rowsBetween(W.unboundedPreceding, 0))
    r = q.withColumn("upto", upto).withColumn("n", F.sum("k").over(W.partitionBy("bin")))
    return r.filter(F.col("upto") > F.expr("n div 2")).groupBy("bin", "n").agg(F.min("s").alias("median"))


@query("agg22_pooled_error", f"""WITH {LONG} SELECT img, c, CAST(sum(pow(v - (v // 8) * 8, 2)) AS DOUBLE) AS sse, round(pow(avg(pow(CAST(v - (v // 8) * 8 AS DOUBLE), 4)), 0.25), 6) AS pooled FROM ch GROUP BY img, c""")
def _(spark, sf):
    e = (F.col("v") - F.expr("v div 8") * 8).cast("double")
    return raw_channels(spark, sf).groupBy("img", "c").agg(F.sum(e * e).alias("sse"), F.round(F.pow(F.avg(F.pow(e, F.lit(4.0))), F.lit(0.25)), 6).alias("pooled"))


@query("agg23_seam_energy", f"""WITH {LONG} SELECT img, c, sum(CASE WHEN x % 8 IN (0, 7) OR y % 8 IN (0, 7) THEN e * e ELSE 0 END) AS seam, sum(e * e) AS whole FROM (SELECT *, CAST(v % 8 AS DOUBLE) AS e FROM ch) GROUP BY img, c""")
def _(spark, sf):
    e = (F.col("v") % 8).cast("double")
    on = (F.col("x") % 8).isin(0, 7) | (F.col("y") % 8).isin(0, 7)
    return raw_channels(spark, sf).groupBy("img", "c").agg(F.sum(F.when(on, e * e).otherwise(0.0)).alias("seam"), F.sum(e * e).alias("whole"))


@query("agg29_common_factor", f"WITH {LONG}, d AS (SELECT DISTINCT img, c, v FROM ch WHERE v > 0) SELECT img, c, CAST(list_reduce(list(v), LAMBDA a, b: gcd(a, b)) AS BIGINT) AS factor FROM d GROUP BY img, c")
def _(spark, sf):
    """gcd over the distinct samples: at most a few hundred of an eight-bit plane."""
    d = raw_channels(spark, sf).filter("v > 0").groupBy("img", "c").agg(F.collect_set("v").alias("s"))
    step = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))["a"]
    return d.select("img", "c", F.aggregate("s", F.lit(0).cast("long"), step).alias("factor"))


@query("agg30_section_bytes", f"""WITH {_RES}, s AS (SELECT img, y // 8 AS section, sum(nbits + 4) AS bits FROM res GROUP BY ALL), b AS (SELECT img, section, CAST(ceil(bits / 8.0) AS BIGINT) AS bytes FROM s)
SELECT img, count(*) AS sections, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(2 + CASE WHEN bytes < 1024 THEN 10 WHEN bytes < 17408 THEN 14 WHEN bytes < 4211712 THEN 22 ELSE 30 END) AS BIGINT) AS toc_bits FROM b GROUP BY img""")
def _(spark, sf):
    s = residuals(spark, sf).groupBy("img", F.expr("y div 8").alias("section")).agg(F.sum(F.col("nbits") + 4).alias("bits"))
    b = s.select("img", F.ceil(F.col("bits") / 8.0).alias("bytes"))
    return b.groupBy("img").agg(F.count("*").alias("sections"), F.sum("bytes").alias("bytes"), F.sum(toc_bits(F.col("bytes"))).alias("toc_bits"))


def toc_bits(n):
    """Bits of a section's size in a table of contents."""
    return F.when(n < 1024, 12).when(n < 17408, 16).when(n < 4211712, 24).otherwise(32).cast("long")


# entropy codes -----------------------------------------------------------------------------------------------------


@query("ent02_canonical_codes", f"""WITH {LETTERS}, h AS (SELECT value AS sym, count(*) AS n FROM letters GROUP BY value), d AS (SELECT sym, CAST(ceil(log2(CAST(sum(n) OVER () AS DOUBLE) / n)) AS BIGINT) AS depth FROM h)
SELECT sym, depth, CAST(floor(coalesce(sum(pow(2.0, -depth)) OVER (ORDER BY depth, sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0, depth)) AS BIGINT) AS code FROM d WHERE depth > 0""")
def _(spark, sf):
    """Codes in order of depth and symbol: each starts where the shares of those before it end."""
    h = planes.letters(spark, sf).groupBy(F.col("value").alias("sym")).agg(F.count("*").alias("n"))
    d = h.select("sym", F.ceil(F.log2(F.sum("n").over(W.partitionBy()).cast("double") / F.col("n"))).alias("depth")).filter("depth > 0")  # an alphabet's rows
    before = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("depth"))).over(W.orderBy("depth", "sym").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return d.select("sym", "depth", F.floor(before * F.pow(F.lit(2.0), F.col("depth"))).alias("code"))


@query("ent03_ans_counts", f"""WITH {LETTERS}, h AS (SELECT value AS sym, count(*) AS n FROM letters GROUP BY value), t AS (SELECT *, sum(n) OVER () AS total FROM h),
f AS (SELECT sym, n, CASE WHEN n <= ((total - 1) >> 11) THEN 1 ELSE (n * 4096) // total END AS f0 FROM (SELECT sym, n, CAST(total AS BIGINT) AS total FROM t)), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, sym) AS k, CAST(4096 - sum(f0) OVER () AS BIGINT) AS rest FROM f),
s AS (SELECT sym, unnest(range(f0, f0 - least(f0 - 1, -rest), -1)) AS level FROM r WHERE rest < 0), o AS (SELECT sym, row_number() OVER (ORDER BY level DESC, sym) AS place FROM s), less AS (SELECT sym, count(*) AS off FROM o WHERE place <= (SELECT max(-rest) FROM r) GROUP BY sym)
SELECT sym, n, CAST(f0 + CASE WHEN k = 1 AND rest > 0 THEN rest ELSE 0 END - coalesce(off, 0) AS BIGINT) AS freq FROM r LEFT JOIN less USING (sym)""")
def _(spark, sf):
    """Counts scaled to 4096; rare symbols keep 1, what is missing goes to the first maximum at once, what is too much comes off
    the first maximum one by one: each symbol's levels, the highest first, are what that takes."""
    h = planes.letters(spark, sf).groupBy(F.col("value").alias("sym")).agg(F.count("*").alias("n"))
    t = h.withColumn("total", F.sum("n").over(W.partitionBy()))  # an alphabet's rows
    f = t.withColumn("f0", F.when(F.col("n") <= F.shiftright(F.col("total") - 1, 11), 1).otherwise(F.expr("(n * 4096) div total")))
    r = f.withColumn("k", F.row_number().over(W.orderBy(F.desc("n"), "sym"))).withColumn("rest", F.lit(4096) - F.sum("f0").over(W.partitionBy()))
    levels = F.sequence(F.col("f0"), F.greatest(F.col("f0") + F.col("rest") + 1, F.lit(2)), F.lit(-1))
    s = r.filter((F.col("rest") < 0) & (F.col("f0") > 1)).select("sym", "rest", F.explode(levels).alias("level"))
    off = s.withColumn("place", F.row_number().over(W.orderBy(F.desc("level"), "sym"))).filter("place <= -rest").groupBy("sym").agg(F.count("*").alias("off"))
    freq = F.col("f0") + F.when((F.col("k") == 1) & (F.col("rest") > 0), F.col("rest")).otherwise(0) - F.coalesce("off", F.lit(0))
    return r.join(F.broadcast(off), "sym", "left").select("sym", "n", freq.cast("long").alias("freq"))


@query("ent07_histogram_distances", f"""WITH {_RES}, h AS (SELECT img % 12 AS ctx, token, count(*) AS n FROM res GROUP BY ALL), own AS (SELECT ctx, {_ENT} AS bits FROM h GROUP BY ctx),
m AS (SELECT a.ctx AS a, b.ctx AS b, h.token, sum(h.n) AS n FROM own a JOIN own b ON a.ctx < b.ctx JOIN h ON h.ctx = a.ctx OR h.ctx = b.ctx GROUP BY a.ctx, b.ctx, h.token), t AS (SELECT a, b, {_ENT} AS bits FROM m GROUP BY a, b)
SELECT a, b, round(t.bits - x.bits - y.bits, 3) AS distance FROM t JOIN own x ON x.ctx = a JOIN own y ON y.ctx = b""")
def _(spark, sf):
    """What merging two contexts costs; each token's counts stand in one row, so pairs need no join of histograms."""
    h = residuals(spark, sf).groupBy((F.col("img") % 12).alias("ctx"), "token").agg(F.count("*").alias("n"))
    wide = h.groupBy("token").pivot("ctx", list(range(12))).agg(F.first("n")).fillna(0)
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    cost = lambda n: F.sum(n) * F.log2(F.sum(n)) - F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0))
    col = lambda k: F.col(f"`{k}`")
    sums = wide.agg(*[F.sum(col(k)).alias(f"t{k}") for k in range(12)], *[cost(col(k)).alias(f"o{k}") for k in range(12)], *[cost(col(a) + col(b)).alias(f"p{a}_{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), ((F.col(f"t{a}") > 0) & (F.col(f"t{b}") > 0)).alias("both"), F.round(F.col(f"p{a}_{b}") - F.col(f"o{a}") - F.col(f"o{b}"), 3).alias("distance")) for a, b in pairs]))
    return sums.select(rows.alias("t")).filter("t.both").select("t.a", "t.b", "t.distance")


_CONFIGS = ((4, 2, 0), (4, 1, 0), (3, 1, 0), (5, 1, 1), (4, 0, 0))


def _config_sql(s: int, m: int, lo: int) -> str:
    k = "(length(bin(z)) - 1)"
    return f"SELECT c, '{s}{m}{lo}' AS config, CASE WHEN z < {1 << s} THEN z ELSE {1 << s} + ({k} - {s}) * {1 << (m + lo)} + ((z - (1::BIGINT << {k}::INT)) >> ({k} - {m})::INT) * {1 << lo} + (z & {(1 << lo) - 1}) END AS token, CASE WHEN z < {1 << s} THEN 0 ELSE {k} - {m + lo} END AS nbits FROM res"


_CONFIG_COST = f"{_RES}, k AS ({' UNION ALL '.join(_config_sql(*c) for c in _CONFIGS)}), kh AS (SELECT c, config, token, count(*) AS n, sum(nbits) AS raw FROM k GROUP BY ALL), kc AS (SELECT c, config, round({_BITS} + sum(raw), 3) AS bits FROM kh GROUP BY c, config)"


@query("ent09_hybrid_configs", f"WITH {_CONFIG_COST} SELECT c, config, bits FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY bits, config) AS r FROM kc) WHERE r = 1")
def _(spark, sf):
    z = F.col("z")
    rows = F.explode(F.array(*[F.struct(F.lit(f"{s}{m}{lo}").alias("config"), codes.hybrid_token(z, s, m, lo).alias("token"), codes.hybrid_bits(z, s, m, lo).alias("nbits")) for s, m, lo in _CONFIGS]))
    t = residuals(spark, sf).select("c", rows.alias("t")).select("c", "t.*")
    cost = token_cost(t, "c", "config").select("c", F.round(F.col("bits") + F.col("raw_bits"), 3).alias("bits"), "config")
    return cost.groupBy("c").agg(F.min(F.struct("bits", "config")).alias("b")).select("c", "b.config", "b.bits")


@query("ent10_token_prices", f"WITH {_RES}, h AS (SELECT c, token, count(*) AS n FROM res GROUP BY ALL) SELECT c, token, n, round(log2(CAST(sum(n) OVER (PARTITION BY c) AS DOUBLE) / n), 6) AS price FROM h")
def _(spark, sf):
    h = histogram(residuals(spark, sf), "c")
    return h.withColumn("price", F.round(F.log2(F.sum("n").over(W.partitionBy("c")).cast("double") / F.col("n")), 6))


@query("join02_two_level_lookup", f"""WITH {_RES}, ctx AS (SELECT k AS ctx, k // 3 AS cluster FROM range(18) AS t(k)), code AS (SELECT cluster, token, 2 + cluster + token // 4 AS depth FROM range(6) AS a(cluster), range(300) AS b(token))
SELECT cluster, count(*) AS tokens, CAST(sum(depth + nbits) AS BIGINT) AS bits FROM res JOIN ctx ON ctx.ctx = res.img % 18 JOIN code USING (cluster, token) GROUP BY cluster""")
def _(spark, sf):
    """Both dimensions have a fixed number of rows and are broadcast.

    Samples are counted by context and token first: on samples, the join's own filter of nulls would work out each token many times over."""
    ctx = spark.range(18).select(F.col("id").alias("ctx"), F.expr("id div 3").alias("cluster"))
    code = spark.range(1800).select(F.expr("id div 300").alias("cluster"), (F.col("id") % 300).alias("token")).withColumn("depth", F.col("cluster") + 2 + F.expr("token div 4"))
    # a null token is none that the code has; said so, its key is never null and nothing is pushed down for it
    h = residuals(spark, sf).groupBy((F.col("img") % 18).alias("ctx"), F.coalesce("token", F.lit(-1)).alias("token")).agg(F.count("*").alias("n"), F.sum("nbits").alias("raw"))
    t = h.join(F.broadcast(ctx), "ctx").join(F.broadcast(code), ["cluster", "token"])
    return t.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.sum(F.col("depth") * F.col("n") + F.col("raw")).alias("bits"))


@query("join04_reconstruction_errors", f"""WITH {LONG}, rec AS (SELECT img, c, i, (v // 6) * 6 + 3 AS v FROM ch) SELECT ch.img, ch.c, CAST(sum(abs(ch.v - rec.v)) AS BIGINT) AS sad, CAST(sum((ch.v - rec.v) * (ch.v - rec.v)) AS BIGINT) AS sse, max(abs(ch.v - rec.v)) AS most,
round(10 * log10(65025.0 * count(*) / sum((ch.v - rec.v) * (ch.v - rec.v))), 4) AS psnr FROM ch JOIN rec ON ch.img = rec.img AND ch.c = rec.c AND ch.i = rec.i GROUP BY ch.img, ch.c""")
def _(spark, sf):
    src = raw_channels(spark, sf)
    rec = src.select("img", "c", "i", (F.expr("v div 6") * 6 + 3).alias("w"))
    e = F.col("v") - F.col("w")
    both = src.join(rec, ["img", "c", "i"]).groupBy("img", "c").agg(F.sum(F.abs(e)).alias("sad"), F.sum(e * e).alias("sse"), F.max(F.abs(e)).alias("most"), F.count("*").alias("m"))
    return both.select("img", "c", "sad", "sse", "most", F.round(F.log10(F.lit(65025.0) * F.col("m") / F.col("sse")) * 10, 4).alias("psnr"))


@query("join03_tree_routing", f"""WITH {YCC}, {nb_sql('ych')}, leaf AS (SELECT * FROM (VALUES (0, -100000, 0, -100000, 100000), (1, 1, 40, -100000, 4), (2, 1, 40, 5, 100000), (3, 41, 100000, -100000, 100000)) AS t(leaf, a0, a1, b0, b1))
SELECT leaf, c, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM nb JOIN leaf ON w + n - nw BETWEEN a0 AND a1 AND abs(w - n) BETWEEN b0 AND b1 GROUP BY leaf, c""")
def _(spark, sf):
    """A tree's node table compiled to nested conditions, so samples are routed without a join."""
    nodes = {0: ("q", 0, 1, 2), 1: ("q", 40, 3, 4), 2: 0, 3: 3, 4: ("r", 4, 5, 6), 5: 2, 6: 1}  # property, threshold, above, below; or a leaf

    def route(k: int):
        if isinstance(nodes[k], int):
            return F.lit(nodes[k])
        p, t, above, below = nodes[k]
        return F.when(F.col(p) > t, route(above)).otherwise(route(below))

    nb = neighbours(ycc(spark, sf)).select("c", "v", (F.col("w") + F.col("n") - F.col("nw")).alias("q"), F.abs(F.col("w") - F.col("n")).alias("r"))
    return nb.groupBy(route(0).alias("leaf"), "c").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("join08_interval_lookup", """WITH k AS (SELECT n, lo, lead(lo, 1, 9.0) OVER (ORDER BY n) AS hi FROM (VALUES (0, 0.0), (1, 0.02), (2, 0.04), (3, 0.06)) AS t(n, lo)) SELECT n AS segment, count(*) AS samples, round(sum(l_tax), 4) AS total FROM lineitem JOIN k ON l_tax >= lo AND l_tax < hi GROUP BY n""")
def _(spark, sf):
    lows = [0.0, 0.02, 0.04, 0.06]
    segment = sum(((F.col("l_tax") >= lo).cast("int") for lo in lows[1:]), F.lit(0))
    return planes.table(spark, sf, "lineitem").filter(F.col("l_tax") >= 0).groupBy(segment.alias("segment")).agg(F.count("*").alias("samples"), F.round(F.sum("l_tax"), 4).alias("total"))


# repetition --------------------------------------------------------------------------------------------------------


@query("ent13_run_mode", f"""WITH {SIGNAL}, q AS (SELECT user_id, t, v // 8000 AS v FROM sig), s AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS pv FROM q)),
r AS (SELECT user_id, run, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, CAST(sum(CASE WHEN n > 3 THEN 1 ELSE n END) AS BIGINT) AS literals, count(*) FILTER (WHERE n > 3) AS copies, CAST(sum(CASE WHEN n > 3 THEN n - 1 ELSE 0 END) AS BIGINT) AS covered FROM r GROUP BY user_id""")
def _(spark, sf):
    w = W.partitionBy("user_id").orderBy("t")
    s = planes.signal(spark, sf).withColumn("v", F.expr("v div 8000"))
    s = s.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("long"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = s.groupBy("user_id", "run").agg(F.count("*").alias("n"))
    long = F.col("n") > 3
    return r.groupBy("user_id").agg(F.sum(F.when(long, 1).otherwise(F.col("n"))).alias("literals"), F.count_if(long).alias("copies"), F.sum(F.when(long, F.col("n") - 1).otherwise(0)).alias("covered"))


@query("ent16_repetition_screen", f"""WITH {LETTERS}, g AS (SELECT stream, value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c, lead(value, 3) OVER w AS d FROM letters WINDOW w AS (PARTITION BY stream ORDER BY seq)),
k AS (SELECT stream, a, b, c, d, count(*) AS n FROM g WHERE d IS NOT NULL GROUP BY ALL) SELECT stream, CAST(sum(n) AS BIGINT) AS grams, count(*) FILTER (WHERE n > 1) AS repeated, max(n) > 1 AS worth FROM k GROUP BY stream""")
def _(spark, sf):
    w = W.partitionBy("stream").orderBy("seq")
    four = [F.col("value"), *[F.lead("value", k).over(w) for k in (1, 2, 3)]]  # bytes, so four of them are one number; null where the last is
    g = planes.letters(spark, sf).select("stream", sum((v * (1 << 8 * k) for k, v in enumerate(four[1:], 1)), four[0]).alias("g")).filter("g is not null")
    k = g.groupBy("stream", "g").agg(F.count("*").alias("n"))
    return k.groupBy("stream").agg(F.sum("n").alias("grams"), F.count_if(F.col("n") > 1).alias("repeated"), (F.max("n") > 1).alias("worth"))


@query("ent17_zero_density", """WITH b AS (SELECT vec_id AS block, k - 1 AS k, CAST(round(embedding[k] * 8) AS BIGINT) AS q FROM embeddings, range(1, 65) AS r(k)),
c AS (SELECT block, k, q, CAST(sum((q <> 0)::INT) OVER (PARTITION BY block ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS left_nz FROM b)
SELECT block, k, q, left_nz, least(left_nz // 2, 8) * 4 + k // 16 AS ctx FROM c WHERE left_nz > 0""")
def _(spark, sf):
    """Coefficients up to the last nonzero, with the context of how many nonzeros are left."""
    q = planes.vectors(spark, sf).select("block", "k", F.round(F.col("v") * 8).cast("long").alias("q"))
    left = F.sum((F.col("q") != 0).cast("long")).over(W.partitionBy("block").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0))
    t = q.withColumn("left_nz", left).filter("left_nz > 0")
    return t.withColumn("ctx", F.least(F.expr("left_nz div 2"), F.lit(8)) * 4 + F.expr("k div 16"))


@query("ent18_residual_tokens", f"WITH {_RES} SELECT img, c, i, e, z, token, nbits FROM res")
def _(spark, sf):
    return residuals(spark, sf).select("img", "c", "i", "e", "z", "token", "nbits")


@query("sup20_lz_symbols", f"""WITH {SIGNAL}, q AS (SELECT user_id, t, v // 8000 AS v FROM sig), s AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS pv FROM q)),
r AS (SELECT user_id, run, v, count(*) AS n FROM s GROUP BY ALL), y AS (SELECT v AS sym, n AS reps, 'literal' AS kind FROM r WHERE n <= 3 UNION ALL SELECT v, 1, 'literal' FROM r WHERE n > 3 UNION ALL SELECT CASE WHEN n - 4 < 16 THEN n - 4 ELSE 12 + length(bin(n - 4)) - 1 END, 1, 'length' FROM r WHERE n > 3)
SELECT kind, sym, CAST(sum(reps) AS BIGINT) AS n FROM y GROUP BY kind, sym""")
def _(spark, sf):
    w = W.partitionBy("user_id").orderBy("t")
    s = planes.signal(spark, sf).withColumn("v", F.expr("v div 8000"))
    s = s.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("long"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = s.groupBy("user_id", "run", "v").agg(F.count("*").alias("n"))
    long = F.col("n") > 3
    literal = F.struct(F.lit("literal").alias("kind"), F.col("v").alias("sym"), F.when(long, 1).otherwise(F.col("n")).alias("reps"))
    length = F.struct(F.lit("length").alias("kind"), codes.hybrid_token(F.greatest(F.col("n") - 4, F.lit(0)), 4, 0, 0).alias("sym"), F.lit(1).cast("long").alias("reps"))
    return r.select(F.explode(F.when(long, F.array(literal, length)).otherwise(F.array(literal))).alias("y")).groupBy("y.kind", "y.sym").agg(F.sum("y.reps").alias("n"))


@query("sup18_stream_choice", f"""WITH {SIGNAL}, q AS (SELECT user_id, t, v // 8000 AS v FROM sig), lit AS (SELECT user_id, CAST(count(*) * 6 AS BIGINT) AS bits FROM q GROUP BY user_id),
s AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS pv FROM q)), r AS (SELECT user_id, run, count(*) AS n FROM s GROUP BY ALL),
rn AS (SELECT user_id, CAST(sum(CASE WHEN n > 3 THEN 6 + 9 ELSE n * 6 END) AS BIGINT) AS bits FROM r GROUP BY user_id)
SELECT lit.user_id, lit.bits AS literal_bits, rn.bits AS run_bits, CASE WHEN rn.bits < lit.bits THEN 'run' ELSE 'literal' END AS choice FROM lit JOIN rn USING (user_id)""")
def _(spark, sf):
    w = W.partitionBy("user_id").orderBy("t")
    s = planes.signal(spark, sf).withColumn("v", F.expr("v div 8000"))
    s = s.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("long"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = s.groupBy("user_id", "run").agg(F.count("*").alias("n"))
    c = r.groupBy("user_id").agg((F.sum("n") * 6).alias("literal_bits"), F.sum(F.when(F.col("n") > 3, 15).otherwise(F.col("n") * 6)).alias("run_bits"))
    return c.withColumn("choice", F.when(F.col("run_bits") < F.col("literal_bits"), "run").otherwise("literal"))


_RCT7 = (0, 6, 5, 10, 26, 40, 12)


def _rct_cost_sql() -> str:
    from mosaicq.plans.rows import _rct_parts

    rows = " UNION ALL ".join(f"SELECT img, {k} AS kind, {j} AS c, i, x, y, {e} AS v FROM rgb" for k in _RCT7 for j, e in enumerate(_rct_parts(k)))
    return f"{RGB}, rr AS ({rows}), rd AS (SELECT img, kind, c, v - CASE WHEN x > 0 THEN lag(v) OVER (PARTITION BY img, kind, c ORDER BY i) ELSE coalesce(lag(v, 32) OVER (PARTITION BY img, kind, c ORDER BY i), 0) END AS e FROM rr), rh AS (SELECT kind, c, e, count(*) AS n FROM rd GROUP BY ALL), rb AS (SELECT kind, c, {_ENT} AS bits FROM rh GROUP BY kind, c), rs AS (SELECT kind, round(sum(bits), 3) AS bits FROM rb GROUP BY kind)"


@query("race03_rct_ranking", "WITH " + _rct_cost_sql() + " SELECT kind, bits, row_number() OVER (ORDER BY bits, kind) AS place FROM rs")
def _(spark, sf):
    """All candidate transforms from one window over the pixels: a transform's left difference is its own of two pixels."""
    px = planes.rgb8(spark, sf).withColumn("c", F.lit(0))
    back = {c: F.when(F.col("x") > 0, F.lag(c).over(W.partitionBy("img").orderBy("i"))).otherwise(F.coalesce(F.lag(c, planes.WIDTH).over(W.partitionBy("img").orderBy("i")), F.lit(None).cast("long"))) for c in "rgb"}
    t = px.select("r", "g", "b", *[v.alias(f"{c}0") for c, v in back.items()])
    now, before = [F.col(c) for c in "rgb"], [F.col(f"{c}0") for c in "rgb"]
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(j).alias("c"), (a - F.coalesce(b, F.lit(0))).alias("e")) for k in _RCT7 for j, (a, b) in enumerate(zip(color.rct(k, now), color.rct(k, before), strict=True))]
    h = t.select(F.explode(F.array(*rows)).alias("t")).groupBy("t.kind", "t.c", "t.e").agg(F.count("*").alias("n"))
    s = h.groupBy("kind", "c").agg(entropy().alias("bits")).groupBy("kind").agg(F.round(F.sum("bits"), 3).alias("bits"))
    return s.withColumn("place", F.row_number().over(W.orderBy("bits", "kind")))  # seven rows


@query("ord05_coefficient_scan", """WITH b AS (SELECT k - 1 AS k, CAST(round(embedding[k] * 8) AS BIGINT) AS q FROM embeddings, range(1, 65) AS r(k)), s AS (SELECT k, sum((q <> 0)::INT) AS nz, count(*) AS n FROM b GROUP BY k)
SELECT k, CAST(nz AS BIGINT) AS nz, row_number() OVER (ORDER BY (k = 0) DESC, nz DESC, k) - 1 AS place FROM s""")
def _(spark, sf):
    q = F.round(F.col("v") * 8)
    s = planes.vectors(spark, sf).groupBy("k").agg(F.count_if(q != 0).alias("nz"))
    return s.withColumn("place", (F.row_number().over(W.orderBy(F.desc(F.col("k") == 0), F.desc("nz"), "k")) - 1).cast("long"))  # 64 rows

