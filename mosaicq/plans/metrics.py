"""Queries of rate and quality summaries, chart tables, races between plans and container layouts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.plans.catalog import query
from mosaicq.plans.sql import LONG, RD
from mosaicq.plans.windows import raw_channels
from mosaicq.sources import planes


def geometric_mean(x):
    """Aggregate: none if any value is not positive."""
    return F.when(F.min(x) > 0, F.exp(F.avg(F.when(x > 0, F.ln(x)))))


_MEANS = "SELECT series, d, count(*) AS images, avg(bpp) AS bpp, avg(m1) AS m1, avg(m2) AS m2, count(m2) AS n2, CASE WHEN min(bpp) > 0 THEN exp(avg(CASE WHEN bpp > 0 THEN ln(bpp) END)) END AS geo, CASE WHEN min(m1) > 0 THEN exp(avg(CASE WHEN m1 > 0 THEN ln(m1) END)) END AS geo1 FROM rd GROUP BY series, d"


def means(spark, sf):
    """(series, d, images, bpp, m1, m2, n2, geo, geo1): missing metrics don't count, and how many there were is told."""
    rd = planes.measurements(spark, sf)
    return rd.groupBy("series", "d").agg(F.count("*").alias("images"), F.avg("bpp").alias("bpp"), F.avg("m1").alias("m1"), F.avg("m2").alias("m2"), F.count("m2").alias("n2"), geometric_mean(F.col("bpp")).alias("geo"), geometric_mean(F.col("m1")).alias("geo1"))


@query("agg24_folder_means", f"WITH {RD}, f AS ({_MEANS}) SELECT series, d, images, round(bpp, 4) AS bpp, round(m1, 6) AS m1, round(m2, 6) AS m2, CASE WHEN n2 <> images THEN n2 END AS partial FROM f")
def _(spark, sf):
    return means(spark, sf).select("series", "d", "images", F.round("bpp", 4).alias("bpp"), F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"), F.when(F.col("n2") != F.col("images"), F.col("n2")).alias("partial"))


@query("agg25_geometric_means", f"WITH {RD}, f AS ({_MEANS}) SELECT series, d, round(geo, 3) AS geo, round(geo1, 6) AS geo1 FROM f")
def _(spark, sf):
    return means(spark, sf).select("series", "d", F.round("geo", 3).alias("geo"), F.round("geo1", 6).alias("geo1"))


@query("agg27_chart_bounds", f"""WITH {RD}, f AS ({_MEANS}), b AS (SELECT min(bpp) AS x0, max(bpp) AS x1, min(m2) AS y0, max(m2) AS y1 FROM f WHERE m2 IS NOT NULL)
SELECT round(x0 - 0.05 * (x1 - x0), 2) AS x_low, round(x1 + 0.05 * (x1 - x0), 2) AS x_high, round(greatest(y0 - 0.08 * (y1 - y0) - 1e-6, 0), 5) AS y_low, round(least(y1 + 0.08 * (y1 - y0) + 1e-6, 100), 5) AS y_high FROM b""")
def _(spark, sf):
    b = means(spark, sf).filter("m2 is not null").agg(F.min("bpp").alias("x0"), F.max("bpp").alias("x1"), F.min("m2").alias("y0"), F.max("m2").alias("y1"))
    x, y = (F.col("x1") - F.col("x0")) * 0.05, (F.col("y1") - F.col("y0")) * 0.08 + 1e-6
    return b.select(F.round(F.col("x0") - x, 2).alias("x_low"), F.round(F.col("x1") + x, 2).alias("x_high"), F.round(F.greatest(F.col("y0") - y, F.lit(0.0)), 5).alias("y_low"), F.round(F.least(F.col("y1") + y, F.lit(100.0)), 5).alias("y_high"))


@query("agg28_log_ticks", f"""WITH {RD}, f AS ({_MEANS}), b AS (SELECT min(bpp) / 8 AS lo, max(bpp) * 8 AS hi FROM f), t AS (SELECT m * pow(10.0, e) AS tick FROM (VALUES (1), (2), (3), (5)) AS m(m), range(-3, 7) AS e(e)) SELECT round(tick, 6) AS tick FROM t, b WHERE tick >= lo AND tick <= hi""")
def _(spark, sf):
    b = means(spark, sf).agg((F.min("bpp") / 8).alias("lo"), (F.max("bpp") * 8).alias("hi"))
    ticks = F.explode(F.flatten(F.transform(F.sequence(F.lit(-3), F.lit(6)), lambda e: F.transform(F.array(*[F.lit(float(m)) for m in (1, 2, 3, 5)]), lambda m: m * F.pow(F.lit(10.0), e)))))
    return b.select("lo", "hi", ticks.alias("tick")).filter("tick >= lo and tick <= hi").select(F.round("tick", 6).alias("tick"))


@query("met06_image_series", f"WITH {RD} SELECT image, series, d, count(*) AS runs, round(min(bpp), 7) AS bpp, max(m1) AS m1 FROM rd GROUP BY image, series, d")
def _(spark, sf):
    return planes.measurements(spark, sf).groupBy("image", "series", "d").agg(F.count("*").alias("runs"), F.round(F.min("bpp"), 7).alias("bpp"), F.max("m1").alias("m1"))


@query("met07_monotone_series", f"""WITH {RD}, f AS ({_MEANS}), s AS (SELECT series, d, bpp, lag(bpp) OVER (PARTITION BY series ORDER BY d) AS before, min(bpp) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f)
SELECT series, d, round(bpp, 4) AS bpp, coalesce(bpp <= before, true) AS monotone, coalesce(bpp < best, true) AS frontier FROM s""")
def _(spark, sf):
    w = W.partitionBy("series").orderBy("d")
    bpp = F.col("bpp")
    return means(spark, sf).select("series", "d", F.round("bpp", 4).alias("bpp"), F.coalesce(bpp <= F.lag("bpp").over(w), F.lit(True)).alias("monotone"), F.coalesce(bpp < F.min("bpp").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).alias("frontier"))


_REC = f"{LONG}, e AS (SELECT img, c, i, x, y, CAST(v AS DOUBLE) AS a, CAST((v // 6) * 6 + 3 AS DOUBLE) AS b FROM ch)"


def reconstruction(spark, sf):
    return raw_channels(spark, sf).select("img", "c", "i", "x", "y", F.col("v").cast("double").alias("a"), (F.expr("v div 6") * 6 + 3).cast("double").alias("b"))


# What the six terms weigh - structure at a quarter and at half the size, its fourth norm, and the gradients' error, excess and loss.
WEIGHTS = (109.4163228369586, 4.685925102200196, 2.491781270704224, 2.167275675983448, 4.55227651921194, 2.847714678987977)
_MOMENTS = {"n": "1", "a": "a", "b": "b", "aa": "a * a", "bb": "b * b", "ab": "a * b"}


def _structure(unit: float) -> str:
    """One less the structural similarity from a window's integer sums, whose samples are `unit` for white."""
    mean, var = "({0}::DOUBLE / n / {1!r}::DOUBLE)", "greatest(({0}{0}::DOUBLE / n - pow({0}::DOUBLE / n, 2)) / {1!r}::DOUBLE, 0.0::DOUBLE)"
    cov = f"((ab::DOUBLE / n - (a::DOUBLE / n) * (b::DOUBLE / n)) / {unit * unit!r}::DOUBLE)"
    apart = f"pow({mean.format('a', unit)} - {mean.format('b', unit)}, 2)"
    return f"greatest(1 - (1 - {apart}) * (2 * {cov} + 0.0009::DOUBLE) / ({var.format('a', unit * unit)} + {var.format('b', unit * unit)} + 0.0009::DOUBLE), 0.0::DOUBLE)"


def _scale_sql(name: str, source: str, unit: float) -> str:
    sums = lambda over, own: ", ".join(f"CAST(sum({e if own else k}) OVER {over} AS BIGINT) AS {k}" for k, e in _MOMENTS.items())
    return f"""{name} AS (SELECT img, x // 2 AS x, y // 2 AS y, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM {source} GROUP BY img, x // 2, y // 2 HAVING count(*) = 4),
{name}r AS (SELECT img, x, y, {sums('(PARTITION BY img, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', True)} FROM {name}),
{name}w AS (SELECT img, {sums('(PARTITION BY img, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', False)} FROM {name}r),
{name}p AS (SELECT img, avg(s) AS mean, pow(avg(pow(s, 4)), 0.25) AS fourth FROM (SELECT img, {_structure(unit)} AS s FROM {name}w) GROUP BY img)"""


_GRADIENT = "avg(abs(db - da)) / 255 AS error, avg(greatest(abs(db) - abs(da), 0)) / 255 AS excess, pow(avg(pow(greatest(abs(da) - abs(db), 0) / 255.0, 4)), 0.25) AS loss"


@query("met04_luma_proxy", f"""WITH {LONG}, e AS (SELECT img, i, x, y, v AS a, (v // 6) * 6 + 3 AS b FROM ch WHERE c = 1), {_scale_sql('half', 'e', 1020.0)}, {_scale_sql('quart', 'half', 4080.0)},
t AS (SELECT img, CASE WHEN x < 31 THEN lead(a) OVER w END - a AS ra, CASE WHEN x < 31 THEN lead(b) OVER w END - b AS rb, lead(a, 32) OVER w - a AS ua, lead(b, 32) OVER w - b AS ub FROM e WINDOW w AS (PARTITION BY img ORDER BY i)),
g AS (SELECT img, {_GRADIENT} FROM (SELECT img, ra AS da, rb AS db FROM t WHERE ra IS NOT NULL UNION ALL SELECT img, ua, ub FROM t WHERE ua IS NOT NULL) GROUP BY img)
SELECT img, round(q.mean, 6) AS quarter, round(h.mean, 6) AS half, round(h.fourth, 6) AS half_fourth, round(error, 6) AS error, round(excess, 6) AS excess, round(loss, 6) AS loss,
round({WEIGHTS[0]!r}::DOUBLE * q.mean + {WEIGHTS[1]!r}::DOUBLE * h.mean + {WEIGHTS[2]!r}::DOUBLE * h.fourth + {WEIGHTS[3]!r}::DOUBLE * error + {WEIGHTS[4]!r}::DOUBLE * excess + {WEIGHTS[5]!r}::DOUBLE * loss, 4) AS score FROM quartp q JOIN halfp h USING (img) JOIN g USING (img)""")
def _(spark, sf):
    """Structure lost at half and quarter size, in windows of five by five cut at the edges, and gradients lost or added at full size.

    Window sums are whole numbers; the quarter comes from the half."""
    e = raw_channels(spark, sf).filter("c = 1").select("img", "c", "i", "x", "y", F.col("v").alias("a"), (F.expr("v div 6") * 6 + 3).alias("b"))

    def smaller(px):
        cells = px.groupBy("img", F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("m"))
        return cells.filter("m = 4").drop("m")

    def pooled(cells, unit: float, name: str):
        row, col = (W.partitionBy("img", p).orderBy(q).rowsBetween(-2, 2) for p, q in (("y", "x"), ("x", "y")))
        sums = cells.select("img", "x", "y", *[F.sum(F.expr(m)).over(row).alias(k) for k, m in _MOMENTS.items()])
        sums = sums.select("img", *[F.sum(k).over(col).alias(k) for k in _MOMENTS])
        lost = F.expr(_structure(unit))
        return sums.select("img", lost.alias("s")).groupBy("img").agg(F.avg("s").alias(f"{name}_mean"), F.pow(F.avg(F.pow("s", F.lit(4.0))), F.lit(0.25)).alias(f"{name}_fourth"))

    half = smaller(e)
    h, q = pooled(half, 1020.0, "h"), pooled(smaller(half), 4080.0, "q")
    w = W.partitionBy("img").orderBy("i")
    right = [(F.when(F.col("x") < planes.WIDTH - 1, F.lead(k).over(w)) - F.col(k)).alias(f"r{k}") for k in "ab"]
    under = [(F.lead(k, planes.WIDTH).over(w) - F.col(k)).alias(f"u{k}") for k in "ab"]
    t = e.select("img", *right, *under).select("img", F.expr("stack(2, ra, rb, ua, ub) AS (da, db)")).filter("da is not null")
    g = t.groupBy("img").agg(F.expr("avg(abs(db - da)) / 255").alias("error"), F.expr("avg(greatest(abs(db) - abs(da), 0)) / 255").alias("excess"), F.expr("pow(avg(pow(greatest(abs(da) - abs(db), 0) / 255.0D, 4)), 0.25D)").alias("loss"))
    terms = [F.col(k) for k in ("q_mean", "h_mean", "h_fourth", "error", "excess", "loss")]
    score = sum((x * v for x, v in zip(terms[1:], WEIGHTS[1:], strict=True)), terms[0] * WEIGHTS[0])
    names = ("quarter", "half", "half_fourth", "error", "excess", "loss")
    return q.join(h, "img").join(g, "img").select("img", *[F.round(x, 6).alias(n) for x, n in zip(terms, names, strict=True)], F.round(score, 4).alias("score"))


@query("met05_quality_gate", f"WITH {_REC}, s AS (SELECT img, c, max(abs(a - b)) AS most, avg((a - b) * (a - b)) AS mse FROM e GROUP BY ALL) SELECT img, round(max(mse), 6) AS worst, max(most) AS most, max(most) <= 3 AND max(mse) <= 4 AS passed FROM s GROUP BY img")
def _(spark, sf):
    d = F.col("a") - F.col("b")
    s = reconstruction(spark, sf).groupBy("img", "c").agg(F.max(F.abs(d)).alias("most"), F.avg(d * d).alias("mse"))
    return s.groupBy("img").agg(F.round(F.max("mse"), 6).alias("worst"), F.max("most").alias("most"), ((F.max("most") <= 3) & (F.max("mse") <= 4)).alias("passed"))


# The luma weights, the texture of 0.0231 that counts as one, and the exponents below and above it.
@query("sup13_texture_factor", f"""WITH {LONG}, l AS (SELECT img, y, x, 0.2126 * r / 255 + 0.7152 * g / 255 + 0.0722 * b / 255 AS l FROM rgb), d AS (SELECT img, abs(l - lag(l) OVER (PARTITION BY img, y ORDER BY x)) AS d FROM l), m AS (SELECT img, avg(d) / 0.0231 AS k FROM d GROUP BY img)
SELECT img, round(least(greatest(pow(k, CASE WHEN k < 1 THEN 0.16 ELSE 0.08 END), 0.5), 2.0), 6) AS factor FROM m""")
def _(spark, sf):
    light = (F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722) / 255
    px = planes.rgb8(spark, sf).select("img", "x", "y", light.alias("l"))
    d = px.select("img", F.abs(F.col("l") - F.lag("l").over(W.partitionBy("img", "y").orderBy("x"))).alias("d"))
    k = F.avg("d") / 0.0231
    return d.groupBy("img").agg(F.round(F.least(F.greatest(F.when(k < 1, F.pow(k, F.lit(0.16))).otherwise(F.pow(k, F.lit(0.08))), F.lit(0.5)), F.lit(2.0)), 6).alias("factor"))


# budgets ------------------------------------------------------------------------------------------------------------

@query("race06_budget_fit", """WITH s AS (SELECT img, sum(r) AS size FROM (SELECT l_suppkey AS img, l_quantity AS r FROM lineitem) GROUP BY img), t AS (SELECT img, k, size * (log2(k) + 1) / 5 AS bytes FROM s, (VALUES (255), (128), (64), (32), (15), (7), (3), (1)) AS v(k))
SELECT img, max(k) FILTER (WHERE bytes <= 20000) AS steps FROM t GROUP BY img""")
def _(spark, sf):
    """The finest coverage that the budget allows."""
    s = planes.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("img")).agg(F.sum("l_quantity").alias("size"))
    steps = (255, 128, 64, 32, 15, 7, 3, 1)
    fit = F.coalesce(*[F.when(F.col("size") * (F.log2(F.lit(float(k))) + 1) / 5 <= 20000, F.lit(k)) for k in steps])
    return s.select("img", fit.alias("steps"))


# containers -------------------------------------------------------------------------------------------------------

# A container's boxes in order: kind, when it is there, and the bytes that it holds. A level box only declares level 10.
_KINDS = (
    ("JXL ", "true", "4"), ("ftyp", "true", "12"), ("jxll", "page_id % 3 = 0", "1"), ("jhgm", "page_id % 5 = 0", "octet_length(encode(url)) + 8"),
    ("Exif", "url IS NOT NULL", "octet_length(encode(url)) + 4"), ("xml ", "page_id % 2 = 0", "octet_length(encode(url)) * 2"), ("jxlc", "true", "octet_length(encode(html))"),
)
_BOXES = "b AS (" + " UNION ALL ".join(f"SELECT page_id AS file, {k} AS place, '{n}' AS kind, 8 + {size} AS size FROM pages WHERE html IS NOT NULL AND {there}" for k, (n, there, size) in enumerate(_KINDS)) + ")"


def boxes(spark, sf):
    """(file, place, kind, size) of a container around each page; what a page hasn't got has no box."""
    rows = [F.when(F.expr(there), F.struct(F.lit(k).alias("place"), F.lit(n).alias("kind"), (F.expr(size.replace("encode(url)", "url").replace("encode(html)", "html")) + 8).cast("long").alias("size"))) for k, (n, there, size) in enumerate(_KINDS)]
    return planes.table(spark, sf, "pages").filter("html is not null").select(F.col("page_id").alias("file"), F.explode(F.array_compact(F.array(*rows))).alias("b")).select("file", "b.*")


@query("snk03_container_boxes", f"WITH {_BOXES} SELECT file, row_number() OVER w - 1 AS pos, kind, size, CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM b WINDOW w AS (PARTITION BY file ORDER BY place)")
def _(spark, sf):
    """Where each box starts; boxes tile the file."""
    w = W.partitionBy("file").orderBy("place")
    b = boxes(spark, sf).withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "start": F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    return b.select("file", "pos", "kind", "size", "start")


@query("snk04_metadata_boxes", "SELECT page_id, length(html) AS plain, length(url) * 3 AS packed, CASE WHEN length(url) * 3 < length(html) THEN 'brob' ELSE 'xml ' END AS kind FROM pages")
def _(spark, sf):
    plain, packed = F.length("html").cast("long"), (F.length("url") * 3).cast("long")
    return planes.table(spark, sf, "pages").select("page_id", plain.alias("plain"), packed.alias("packed"), F.when(packed < plain, "brob").otherwise("xml ").alias("kind"))


def _side(e: str) -> str:
    return f"CASE WHEN {e} <= 512 THEN 11 WHEN {e} <= 8192 THEN 15 WHEN {e} <= 262144 THEN 20 ELSE 32 END"


@query("snk02_size_header", f"WITH p AS (SELECT p_partkey, p_size * 37 AS width, p_partkey * 211 % 400000 + 1 AS height FROM part) SELECT p_partkey, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, 16 + 1 + {_side('height')} + 3 + {_side('width')} AS bits FROM p")
def _(spark, sf):
    """A codestream's start: two bytes that name it, no small form, height, no fixed ratio, width."""
    p = planes.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 37).cast("long").alias("width"), F.expr("p_partkey * 211 % 400000 + 1").cast("long").alias("height"))
    return p.withColumn("bits", F.expr(f"20 + {_side('height')} + {_side('width')}"))


@query("snk01_bit_totals", f"WITH {LONG} SELECT img, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE length(bin(v)) END) AS BIGINT) AS bits, CAST(ceil(sum(CASE WHEN v = 0 THEN 1 ELSE length(bin(v)) END) / 8.0) AS BIGINT) AS bytes FROM ch GROUP BY img")
def _(spark, sf):
    n = F.when(F.col("v") == 0, 1).otherwise(F.length(F.bin("v")))
    return raw_channels(spark, sf).groupBy("img").agg(F.sum(n).alias("bits"), F.ceil(F.sum(n) / 8.0).alias("bytes"))
