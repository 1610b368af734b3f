"""Queries of scans and row-wise projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaicq.functions import codes, color
from mosaicq.plans.catalog import query
from mosaicq.plans.sql import LIN, LONG, PX, RD, RGB, XYB, YCC
from mosaicq.sources import planes

KEY = ("img", "i")


def _with(*columns: str) -> str:
    return ", ".join(columns)


# scans ------------------------------------------------------------------------------------------------------------

_SCAN = "WITH " + LONG + " SELECT img, c, i, x, y, v FROM ch"


@query("src01_rgb8_scan", _SCAN)
def _(spark, sf):
    return planes.scan_interleaved(planes.buffers(planes.rgb8(spark, sf), "r", "g", "b"), 3)


@query("src02_rgba8_scan", "WITH " + LONG + " SELECT img, c, i, x, y, v FROM ch UNION ALL SELECT img, 3, i, x, y, a FROM rgb")
def _(spark, sf):
    return planes.scan_interleaved(planes.buffers(planes.rgb8(spark, sf), "r", "g", "b", "a"), 4)


def _deep(factor: int, bits: int) -> str:
    return f"WITH {LONG} SELECT img, c, i, x, y, least(v * {factor}, {(1 << bits) - 1}) AS v FROM ch"


for _bits, _factor in ((10, 5), (12, 17), (16, 300)):

    @query(f"src03_rgb{_bits}_scan", _deep(_factor, _bits))
    def _(spark, sf, bits=_bits, factor=_factor):
        px = planes.rgb8(spark, sf).select("img", "i", *[(F.col(c) * factor).alias(c) for c in "rgb"])
        return planes.scan_interleaved(planes.buffers(px, "r", "g", "b"), 3, bits)


@query("src04_gray16_alpha_scan", f"WITH {RGB} SELECT img, 0 AS c, i, x, y, least(r * 300, 65535) AS v FROM rgb UNION ALL SELECT img, 1, i, x, y, a FROM rgb")
def _(spark, sf):
    px = planes.rgb8(spark, sf).select("img", "i", (F.col("r") * 300).alias("r"), "a")
    return planes.scan_interleaved(planes.buffers(px, "r", "a"), 2, 16)


@query("src06_cmyk_scan", f"WITH {RGB} SELECT img, i, 255 - r AS c, 255 - g AS m, 255 - b AS y_ink, a AS k FROM rgb")
def _(spark, sf):
    return planes.rgb8(spark, sf).select("img", "i", *[(F.lit(255) - F.col(c)).alias(n) for c, n in (("r", "c"), ("g", "m"), ("b", "y_ink"))], F.col("a").alias("k"))


@query("src10_batch_status", """WITH f AS (SELECT page_id, CASE WHEN url IS NULL OR length(html) = 0 THEN 'failed' WHEN page_id % 5 = 0 THEN 'skipped' ELSE 'converted' END AS status, length(html) AS n FROM pages)
SELECT status, count(*) AS files, sum(n) AS characters FROM f GROUP BY status""")
def _(spark, sf):
    f = planes.table(spark, sf, "pages")
    n = F.length("html").cast("long")
    status = F.when(F.col("url").isNull() | (n == 0), "failed").when(F.col("page_id") % 5 == 0, "skipped").otherwise("converted")
    return f.groupBy(status.alias("status")).agg(F.count("*").alias("files"), F.sum(n).alias("characters"))


# colour -----------------------------------------------------------------------------------------------------------


@query("prj01_srgb_to_linear", f"WITH {LIN} SELECT img, i, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM lin")
def _(spark, sf):
    return planes.rgb8(spark, sf).select(*KEY, *[F.round(color.srgb_to_linear(F.col(c) / 255.0), 6).alias(c) for c in "rgb"])


def linear(spark, sf):
    return planes.rgb8(spark, sf).select(*KEY, "x", "y", *[color.srgb_to_linear(F.col(c) / 255.0).alias(c) for c in "rgb"])


_TRANSFERS = {
    "pq": "pow(greatest(pow(v, 32.0 / 2523) - 3424.0 / 4096, 0) / (2413.0 / 128 - (2392.0 / 128) * pow(v, 32.0 / 2523)), 16384.0 / 2610) * (10000.0 / 255)",
    "hlg": "CASE WHEN v <= 0.5 THEN v * v / 3 ELSE (exp((v - 0.5599107) / 0.17883277) + 0.28466892) / 12 END",
    "bt709": "CASE WHEN v < 4.5 * 0.01805397 THEN v / 4.5 ELSE pow((v + 0.0992968) / 1.0992968, 1 / 0.45) END",
    "bt470m": "pow(v, 2.2)",
    "bt470bg": "pow(v, 2.8)",
    "smpte240": "CASE WHEN v < 0.0912 THEN v / 4 ELSE pow((v + 0.1115) / 1.1115, 1 / 0.45) END",
    "smpte428": "pow(v, 2.6)",
}


@query("prj02_transfer_functions", f"WITH {RGB}, s AS (SELECT img, i, r / 255.0 AS v FROM rgb) SELECT img, i, {_with(*[f'round({e}, 6) AS {n}' for n, e in _TRANSFERS.items()])} FROM s")
def _(spark, sf):
    v = F.col("r") / 255.0
    return planes.rgb8(spark, sf).select(*KEY, *[F.round(color.to_linear(n, v), 6).alias(n) for n in _TRANSFERS])


@query("prj03_transfer_table", f"""WITH {RGB}, lut AS (SELECT k AS code, CASE WHEN k / 255.0 <= 0.04045 THEN k / 255.0 / 12.92 ELSE pow((k / 255.0 + 0.055) / 1.055, 2.4) END AS light FROM range(256) AS t(k))
SELECT img, round(avg(light), 6) AS mean_light, count(*) AS n FROM rgb JOIN lut ON rgb.g = lut.code GROUP BY img""")
def _(spark, sf):
    lut = spark.range(256).select(F.col("id").alias("code"), color.srgb_to_linear(F.col("id") / 255.0).alias("light"))  # 256 rows
    px = planes.rgb8(spark, sf)
    return px.join(F.broadcast(lut), px.g == lut.code).groupBy("img").agg(F.round(F.avg("light"), 6).alias("mean_light"), F.count("*").alias("n"))


def _matrix_sql(name: str) -> str:
    return _with(*[f"round({m[0]!r} * r + {m[1]!r} * g + {m[2]!r} * b, 6) AS {c}" for m, c in zip(color.to_srgb_matrix(name).tolist(), "rgb", strict=True)])


for _name in ("p3", "bt2020"):

    @query(f"prj04_primaries_{_name}", f"WITH {LIN} SELECT img, i, {_matrix_sql(_name)} FROM lin")
    def _(spark, sf, name=_name):
        out = color.apply_matrix(color.to_srgb_matrix(name), [F.col(c) for c in "rgb"])
        return linear(spark, sf).select(*KEY, *[F.round(v, 6).alias(c) for v, c in zip(out, "rgb", strict=True)])


def xyb_pixels(spark, sf):
    x, y, b = color.xyb(F.col("r"), F.col("g"), F.col("b"))
    return linear(spark, sf).select(*KEY, "x", "y", x.alias("xx"), y.alias("yy"), b.alias("bb"))


@query("prj05_xyb", f"WITH {XYB} SELECT img, i, round(xx, 6) AS xx, round(yy, 6) AS yy, round(bb, 6) AS bb FROM xyb")
def _(spark, sf):
    return xyb_pixels(spark, sf).select(*KEY, *[F.round(c, 6).alias(c) for c in ("xx", "yy", "bb")])


_CUBES = "pow(yy + xx + 0.1559542, 3) - 0.0037930734 AS l, pow(yy - xx + 0.1559542, 3) - 0.0037930734 AS m, pow(bb + 0.1559542, 3) - 0.0037930734 AS s"


@query("prj06_xyb_inverse", f"""WITH {XYB}, k AS (SELECT img, i, {_CUBES} FROM xyb) SELECT img, i, {_with(*[f'round({m[0]} * l + ({m[1]}) * m + ({m[2]}) * s, 6) AS {c}' for m, c in zip(color.UNMIX, 'rgb', strict=True)])} FROM k""")
def _(spark, sf):
    out = color.xyb_to_rgb(F.col("xx"), F.col("yy"), F.col("bb"))
    return xyb_pixels(spark, sf).select(*KEY, *[F.round(v, 6).alias(c) for v, c in zip(out, "rgb", strict=True)])


_LATTICE = "SELECT img, i, x, y, CAST(round(xx * 4096) AS BIGINT) AS qx, CAST(round(yy * 512) AS BIGINT) AS qy, CAST(round(bb * 256) AS BIGINT) - CAST(round(yy * 512) AS BIGINT) AS qb FROM xyb"


@query("prj07_xyb_lattice", f"""WITH {XYB}, q AS ({_LATTICE}), t AS (SELECT *, qx - qb AS co, qb + ((qx - qb) >> 1) AS t FROM q)
SELECT img, i, qx, qy, qb, t + ((qy - t) >> 1) AS y0, co, qy - t AS cg FROM t""")
def _(spark, sf):
    q = xyb_pixels(spark, sf).select(*KEY, *[v.alias(n) for v, n in zip(color.xyb_lattice(F.col("xx"), F.col("yy"), F.col("bb")), ("qx", "qy", "qb"), strict=True)])
    return q.select("*", *[v.alias(n) for v, n in zip(color.ycocg(F.col("qx"), F.col("qy"), F.col("qb")), ("y0", "co", "cg"), strict=True)])


@query("prj08_ycbcr", f"WITH {RGB}, l AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS l FROM rgb) SELECT img, i, round(l, 6) AS luma, round((b - l) / 1.772 + 128, 6) AS cb, round((r - l) / 1.402 + 128, 6) AS cr FROM l")
def _(spark, sf):
    return planes.rgb8(spark, sf).select(*KEY, *[F.round(v, 6).alias(n) for v, n in zip(color.ycbcr(F.col("r"), F.col("g"), F.col("b")), ("luma", "cb", "cr"), strict=True)])


@query("prj09_ycocg", f"WITH {YCC} SELECT img, i, c0, c1, c2, true AS exact FROM ycc")
def _(spark, sf):
    rgb = [F.col(c) for c in "rgb"]
    ycc = planes.rgb8(spark, sf).select(*KEY, *"rgb", *[v.alias(f"c{k}") for k, v in enumerate(color.ycocg(*rgb))])
    back = color.ycocg_inverse(*[F.col(f"c{k}") for k in range(3)])
    exact = (back[0] == rgb[0]) & (back[1] == rgb[1]) & (back[2] == rgb[2])
    return ycc.select(*KEY, "c0", "c1", "c2", exact.alias("exact"))


def _rct_parts(kind: int) -> tuple[str, str, str]:
    p, step = divmod(kind, 7)
    c = ["r", "g", "b"]
    a, b, d = c[p % 3], c[(p + 1 + p // 3) % 3], c[(p + 2 - p // 3) % 3]
    if step == 6:
        t = f"({d} + (({a} - {d}) >> 1))"
        return f"{t} + (({b} - {t}) >> 1)", f"{a} - {d}", f"{b} - {t}"
    return a, {0: b, 1: f"{b} - {a}", 2: f"{b} - (({a} + {d}) >> 1)"}[step // 2], f"{d} - {a}" if step % 2 else d


def _rct_sql(kind: int) -> str:
    out = _rct_parts(kind)
    return f"SELECT img, {kind} AS kind, sum(abs({out[0]})) AS s0, sum(abs({out[1]})) AS s1, sum(abs({out[2]})) AS s2 FROM rgb GROUP BY img"


@query("prj10_rct_all", f"WITH {RGB} " + " UNION ALL ".join(_rct_sql(k) for k in range(42)))
def _(spark, sf):
    """One scan: the 42 transforms are 126 sums over the same rows, unpivoted afterwards."""
    rgb = [F.col(c) for c in "rgb"]
    sums = [F.sum(F.abs(v)).alias(f"s{k}_{j}") for k in range(42) for j, v in enumerate(color.rct(k, rgb))]
    wide = planes.rgb8(spark, sf).groupBy("img").agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"s{k}_{j}").alias(f"s{j}") for j in range(3)]) for k in range(42)]))
    return wide.select("img", rows.alias("t")).select("img", "t.*")


# integer codes ----------------------------------------------------------------------------------------------------

_SIGNED = f"{YCC}, z AS (SELECT img, i, c1 AS v, CASE WHEN c1 >= 0 THEN 2 * c1 ELSE -2 * c1 - 1 END AS u FROM ycc)"


def _signed(spark, sf):
    v = color.ycocg(F.col("r"), F.col("g"), F.col("b"))[1]
    return planes.rgb8(spark, sf).select(*KEY, v.alias("v")).withColumn("u", codes.zigzag(F.col("v")))


@query("prj11_zigzag", f"WITH {_SIGNED} SELECT img, i, v, u, v AS back FROM z")
def _(spark, sf):
    return _signed(spark, sf).withColumn("back", codes.unzigzag(F.col("u")))


def _hybrid_sql(s: int, m: int, lo: int) -> str:
    k = "(length(bin(u)) - 1)"
    token = f"{1 << s} + ({k} - {s}) * {1 << (m + lo)} + ((u - (1::BIGINT << {k}::INT)) >> ({k} - {m})::INT) * {1 << lo} + (u & {(1 << lo) - 1})"
    return f"CASE WHEN u < {1 << s} THEN u ELSE {token} END AS t{s}{m}{lo}, CASE WHEN u < {1 << s} THEN 0 ELSE {k} - {m + lo} END AS n{s}{m}{lo}"


_CONFIGS = ((4, 2, 0), (4, 1, 0), (3, 1, 0), (5, 1, 1), (4, 0, 0))


@query("prj12_hybrid_integers", f"WITH {_SIGNED} SELECT img, i, u, {_with(*[_hybrid_sql(*c) for c in _CONFIGS])} FROM z")
def _(spark, sf):
    u = F.col("u")
    cols = [c for s, m, lo in _CONFIGS for c in (codes.hybrid_token(u, s, m, lo).alias(f"t{s}{m}{lo}"), codes.hybrid_bits(u, s, m, lo).alias(f"n{s}{m}{lo}"))]
    return _signed(spark, sf).select(*KEY, "u", *cols)


@query("prj13_lz_lengths", "SELECT k AS length, CASE WHEN k - 3 < 16 THEN k - 3 ELSE 12 + length(bin(k - 3)) - 1 END AS token, CASE WHEN k - 3 < 16 THEN 0 ELSE length(bin(k - 3)) - 1 END AS nbits FROM range(3, 5000) AS t(k)")
def _(spark, sf):
    v = F.col("id") - 3
    return spark.range(3, 5000).select(F.col("id").alias("length"), codes.hybrid_token(v, 4, 0, 0).alias("token"), codes.hybrid_bits(v, 4, 0, 0).alias("nbits"))


@query("prj14_varint", "SELECT o_orderkey, greatest(1, CAST(ceil(length(bin(greatest(o_orderkey, 1))) / 7.0) AS BIGINT)) AS bytes FROM orders")
def _(spark, sf):
    return planes.table(spark, sf, "orders").select("o_orderkey", codes.varint_bytes(F.col("o_orderkey")).alias("bytes"))


# quality and distance ---------------------------------------------------------------------------------------------

_Q2D = "least(CASE WHEN q >= 99 THEN 0.05 * pow(2.0, 100 - q) WHEN q >= 90 THEN pow(10.0, (99 - q) / 9.0 - 1) WHEN q >= 30 THEN 0.1 + (100 - q) * 0.09 ELSE 6.24 + pow(2.5, (30 - q) / 5.0) / 6.25 END, 25)"


@query("prj15_quality_to_distance", f"SELECT q, round({_Q2D}, 6) AS distance FROM (SELECT k / 4.0 AS q FROM range(401) AS t(k))")
def _(spark, sf):
    q = F.col("id") / 4.0
    return spark.range(401).select(q.alias("q"), F.round(color.distance_from_quality(q), 6).alias("distance"))


_D2Q = "CASE WHEN d <= 0.05 THEN 100 WHEN d <= 0.1 THEN 100 - log2(d / 0.05) WHEN d <= 1 THEN 99 - 9 * (1 + log10(d)) WHEN d <= 6.4 THEN 100 - (d - 0.1) / 0.09 ELSE 30 - 5 * ln((d - 6.24) * 6.25) / ln(2.5) END"


@query("prj16_distance_to_quality", f"""SELECT d, CAST(least(greatest(round({_D2Q}), 1), 100) AS BIGINT) AS jpeg, CAST(least(greatest(round(100 - 10 * d), 1), 100) AS BIGINT) AS avif
FROM (SELECT CAST(k AS DOUBLE) / 64 + 0.003 AS d FROM range(1, 1600) AS t(k))""")
def _(spark, sf):
    d = F.col("id") / 64.0 + 0.003
    return spark.range(1, 1600).select(d.alias("d"), color.jpeg_quality(d).alias("jpeg"), color.avif_quality(d).alias("avif"))


# Fixed values of the adaptive-quantisation schedules.
AQ_KNOTS = [0.5, 1.0, 1.4, 1.75, 3.0, 5.0, 8.0]
AQ_STRENGTH = [0.26565, 0.275459, 0.058287, 0.0, 0.0, 0.0, 0.0]
AQ_LEVEL = [0.636493, 0.648351, 0.606759, 0.48, 0.48, 0.48, 0.48]


@query("prj17_knot_schedules", f"""WITH k AS (SELECT * FROM (VALUES {_with(*[f'({i}, {a}, {s}, {l})' for i, (a, s, l) in enumerate(zip(AQ_KNOTS, AQ_STRENGTH, AQ_LEVEL, strict=True))])}) AS t(n, pos, s, l)),
seg AS (SELECT a.pos AS lo, b.pos AS hi, a.s AS s0, b.s AS s1, a.l AS l0, b.l AS l1 FROM k a JOIN k b ON b.n = a.n + 1),
p AS (SELECT image, 0.3 + image % 90 / 10.0 AS d FROM (SELECT DISTINCT l_suppkey AS image FROM lineitem)),
c AS (SELECT image, d, least(greatest(d, 0.5), 8) AS e FROM p)
SELECT image, round(s0 + (e - lo) * (s1 - s0) / (hi - lo), 6) AS strength, round(l0 + (e - lo) * (l1 - l0) / (hi - lo), 6) AS level FROM c JOIN seg ON e >= lo AND (e < hi OR hi = 8)""")
def _(spark, sf):
    image = planes.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image")).distinct()
    d = F.lit(0.3) + F.col("image") % 90 / 10.0
    return image.select("image", F.round(color.piecewise(d, AQ_KNOTS, AQ_STRENGTH), 6).alias("strength"), F.round(color.piecewise(d, AQ_KNOTS, AQ_LEVEL), 6).alias("level"))


@query("prj18_frame_quantiser", """WITH p AS (SELECT 0.05 + k / 10.0 AS d FROM range(250) AS t(k))
SELECT round(d, 3) AS d, CAST(least(greatest(round(65536 * 0.8 / (10 * d)), 1), 32768) AS BIGINT) AS global_scale, 2 + (d >= 1.25)::INT + (d > 9)::INT AS x_scale, (d >= 0.7)::INT + (d >= 1.5)::INT AS epf_passes FROM p""")
def _(spark, sf):
    d = F.lit(0.05) + F.col("id") / 10.0
    scale = F.least(F.greatest(F.round(F.lit(65536 * 0.8) / (d * 10)), F.lit(1)), F.lit(32768)).cast("long")
    return spark.range(250).select(F.round(d, 3).alias("d"), scale.alias("global_scale"), (F.lit(2) + (d >= 1.25).cast("int") + (d > 9).cast("int")).alias("x_scale"), ((d >= 0.7).cast("int") + (d >= 1.5).cast("int")).alias("epf_passes"))


@query("prj19_near_lossless", f"WITH {RGB} SELECT img, i, {_with(*[f'least(((r + {k}) // {2 * k + 1}) * {2 * k + 1}, 255) AS e{k}' for k in (1, 2, 4)])} FROM rgb")
def _(spark, sf):
    return planes.rgb8(spark, sf).select(*KEY, *[color.nearest_multiple(F.col("r"), k, 255).alias(f"e{k}") for k in (1, 2, 4)])


@query("prj20_signed_multiple", f"WITH {YCC} SELECT img, i, {_with(*[f'CAST(sign(c1) * ((abs(c1) + {k // 2}) // {k}) * {k} AS BIGINT) AS m{k}' for k in (2, 3, 8)])} FROM ycc")
def _(spark, sf):
    v = color.ycocg(F.col("r"), F.col("g"), F.col("b"))[1]
    return planes.rgb8(spark, sf).select(*KEY, *[color.signed_multiple(v, k).alias(f"m{k}") for k in (2, 3, 8)])


@query("prj21_color_keys", f"WITH {YCC} SELECT img, i, (c0 + 1048576) * 4398046511104 + (c1 + 1048576) * 2097152 + (c2 + 1048576) AS key, c0, c1, c2 FROM ycc")
def _(spark, sf):
    c = color.ycocg(F.col("r"), F.col("g"), F.col("b"))
    key = planes.rgb8(spark, sf).select(*KEY, color.color_key(c).alias("key"))
    return key.select(*KEY, "key", *[v.alias(f"c{k}") for k, v in enumerate(color.key_color(F.col("key")))])


@query("prj22_luma_keys", f"WITH {RGB} SELECT img, i, 299 * r + 587 * g + 114 * b AS luma, (77 * r + 150 * g + 29 * b) >> 8 AS luma8 FROM rgb")
def _(spark, sf):
    r, g, b = (F.col(c) for c in "rgb")
    return planes.rgb8(spark, sf).select(*KEY, color.luma(r, g, b).alias("luma"), F.shiftright(r * 77 + g * 150 + b * 29, 8).alias("luma8"))


# What each EXIF orientation does; (swap x and y, mirror x, mirror y), in that order.
ORIENTATIONS = {1: (0, 0, 0), 2: (0, 1, 0), 3: (0, 1, 1), 4: (0, 0, 1), 5: (1, 0, 0), 6: (1, 1, 0), 7: (1, 1, 1), 8: (1, 0, 1)}


@query("prj23_orientation", f"""WITH {PX}, d AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img),
o AS (SELECT * FROM (VALUES {_with(*[f'({k}, {s}, {a}, {b})' for k, (s, a, b) in ORIENTATIONS.items()])}) AS t(code, swap, mx, my)),
p AS (SELECT px.img, i, code, mx, my, CASE WHEN swap = 1 THEN y ELSE x END AS u, CASE WHEN swap = 1 THEN x ELSE y END AS v, CASE WHEN swap = 1 THEN h ELSE w END AS uw, CASE WHEN swap = 1 THEN w ELSE h END AS vh FROM px JOIN d USING (img) JOIN o ON code = 1 + px.img % 8)
SELECT img, i, code, CASE WHEN mx = 1 THEN uw - 1 - u ELSE u END AS x2, CASE WHEN my = 1 THEN vh - 1 - v ELSE v END AS y2 FROM p""")
def _(spark, sf):
    px = planes.pixels(spark, sf)
    o = spark.createDataFrame([(k, *v) for k, v in ORIENTATIONS.items()], "code int, swap int, mx int, my int")  # eight rows
    size = px.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    p = px.join(size, "img").withColumn("code", (F.lit(1) + F.col("img") % 8).cast("int")).join(F.broadcast(o), "code")
    s = F.col("swap") == 1
    u, v, w, h = F.when(s, F.col("y")).otherwise(F.col("x")), F.when(s, F.col("x")).otherwise(F.col("y")), F.when(s, F.col("h")).otherwise(F.col("w")), F.when(s, F.col("w")).otherwise(F.col("h"))
    return p.select("img", "i", "code", F.when(F.col("mx") == 1, w - 1 - u).otherwise(u).alias("x2"), F.when(F.col("my") == 1, h - 1 - v).otherwise(v).alias("y2"))


@query("prj25_transcendentals", "SELECT vec_id, round(sum(exp(v)), 5) AS e, round(sum(log2(1 + abs(v))), 5) AS l, round(sum(sin(v)), 5) AS s, round(sum(cos(v)), 5) AS c, round(sum(atan2(v, 1 + v * v)), 5) AS a FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY vec_id")
def _(spark, sf):
    v = F.col("v")
    parts = {"e": F.exp(v), "l": F.log2(F.abs(v) + 1), "s": F.sin(v), "c": F.cos(v), "a": F.atan2(v, v * v + 1)}
    return planes.vectors(spark, sf).groupBy(F.col("block").alias("vec_id")).agg(*[F.round(F.sum(e), 5).alias(n) for n, e in parts.items()])


@query("prj26_compositing", f"WITH {RGB} SELECT img, i, {_with(*[f'({c} * g + 128 * (255 - g) + 127) // 255 AS {c}' for c in 'rgb'])} FROM rgb")
def _(spark, sf):
    return planes.rgb8(spark, sf).select(*KEY, *[color.blend(F.col(c), F.lit(128), F.col("g")).alias(c) for c in "rgb"])


@query("prj28_exact_division", f"WITH {YCC} SELECT img, i, c1 // 3 AS third, c1 % 3 AS rest, (c1 - (((c1 % 7) + 7) % 7)) // 7 AS floor7 FROM ycc")
def _(spark, sf):
    c1 = color.ycocg(F.col("r"), F.col("g"), F.col("b"))[1]
    v = planes.rgb8(spark, sf).select(*KEY, c1.alias("v"))
    return v.select(*KEY, F.expr("v div 3").alias("third"), (F.col("v") % 3).alias("rest"), F.expr("(v - pmod(v, 7)) div 7").alias("floor7"))


@query("prj29_tick_labels", f"WITH {RD} SELECT d, m, CASE WHEN m LIKE '%.%' THEN rtrim(rtrim(m, '0'), '.') ELSE m END AS label, '-d ' || (CASE WHEN m LIKE '%.%' THEN rtrim(rtrim(m, '0'), '.') ELSE m END) AS note FROM (SELECT DISTINCT d, format('{{:.3f}}', d) AS m FROM rd)")
def _(spark, sf):
    d = planes.measurements(spark, sf).select("d").distinct().withColumn("m", F.format_string("%.3f", F.col("d")))
    label = F.rtrim(F.rtrim(F.col("m"), F.lit("0")), F.lit("."))
    return d.select("d", "m", label.alias("label"), F.concat(F.lit("-d "), label).alias("note"))


@query("prj30_color_ramp", """WITH s AS (SELECT k, 12 AS n FROM range(12) AS t(k)), f AS (SELECT k, CASE WHEN n > 1 THEN k / (n - 1.0) ELSE 0 END AS f FROM s)
SELECT k, CAST(round(40 + f * 180) AS BIGINT) AS red, CAST(round(90 - f * 60) AS BIGINT) AS green, CAST(round(200 - f * 170) AS BIGINT) AS blue FROM f""")
def _(spark, sf):
    f = F.col("id") / 11.0
    ends = {"red": (40, 220), "green": (90, 30), "blue": (200, 30)}
    return spark.range(12).select(F.col("id").alias("k"), *[F.round(F.lit(a) + f * (b - a)).cast("long").alias(n) for n, (a, b) in ends.items()])


@query("prj31_metric_lines", """WITH t AS (SELECT event_id, 'cvvdp = ' || CAST(value AS VARCHAR) || ' JOD' AS line FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'error: none' END FROM events WHERE event_id % 3 > 0)
SELECT event_id, TRY_CAST(nullif(regexp_extract(line, '= *(-?[0-9.]+)', 1), '') AS DOUBLE) AS score FROM t""")
def _(spark, sf):
    """A third of the lines hold a score, a third an error, a third nothing at all."""
    ev = planes.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("cvvdp = "), F.col("value").cast("string"), F.lit(" JOD"))).when(F.col("event_id") % 3 == 1, "error: none")
    return ev.select("event_id", F.regexp_extract(line, r"= *(-?[0-9.]+)", 1).try_cast("double").alias("score"))
