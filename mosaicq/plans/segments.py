"""Queries of tiles, shapes, lattices, orders and layouts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.functions import color
from mosaicq.operators.predict import tap
from mosaicq.plans.catalog import query
from mosaicq.plans.costs import _INDEX, palette_index
from mosaicq.plans.sql import LONG, RGB
from mosaicq.plans.windows import _tap_sql, raw_channels
from mosaicq.sources import planes



def tile():
    """The 4x4 tile of a pixel."""
    return F.expr("x div 4").alias("tx"), F.expr("y div 4").alias("ty")


_TILE = "tile AS (SELECT img, x // 4 AS tx, y // 4 AS ty, list(v ORDER BY i) AS t FROM (SELECT img, x, y, i, a // 255 AS v FROM rgb) GROUP BY ALL HAVING count(*) = 16)"


def tiles(px, value):
    """(img, tx, ty, t): each whole 4x4 tile's samples in raster order."""
    t = px.groupBy("img", *tile()).agg(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))).alias("p"))
    return t.filter(F.size("p") == 16).select("img", "tx", "ty", F.col("p.v").alias("t"))


def masks(spark, sf):
    return tiles(planes.rgb8(spark, sf), F.expr("a div 255"))


@query("seg01_tile_groups", f"WITH {RGB}, {_TILE} SELECT list_aggregate(t, 'sum')::BIGINT AS ink, count(*) AS n, min(img * 1000 + ty * 8 + tx) AS leader FROM tile GROUP BY t HAVING count(*) >= 5")
def _(spark, sf):
    """Equal tiles by their own samples, no hash between; five or more make a group, the first in raster order leads."""
    g = masks(spark, sf).groupBy("t").agg(F.count("*").alias("n"), F.min(F.expr("img * 1000 + ty * 8 + tx")).alias("leader")).filter("n >= 5")
    return g.select(F.aggregate("t", F.lit(0).cast("long"), lambda s, v: s + v).alias("ink"), "n", "leader")


@query("seg02_tile_savings", f"WITH {RGB}, {_TILE}, g AS (SELECT t, count(*) AS n FROM tile GROUP BY t HAVING count(*) >= 2) SELECT count(*) AS shapes, CAST(sum(n) AS BIGINT) AS uses, CAST(sum(greatest((n - 1) * 16 - n * 6, 0)) AS BIGINT) AS saving FROM g")
def _(spark, sf):
    g = masks(spark, sf).groupBy("t").agg(F.count("*").alias("n")).filter("n >= 2")
    return g.agg(F.count("*").alias("shapes"), F.sum("n").alias("uses"), F.sum(F.greatest((F.col("n") - 1) * 16 - F.col("n") * 6, F.lit(0))).alias("saving"))


@query("seg03_mask_signatures", f"WITH {RGB}, {_TILE} SELECT img, count(DISTINCT t) AS kinds, count(*) AS n, count(*) FILTER (WHERE list_aggregate(t, 'sum') = 16) AS solid FROM tile GROUP BY img")
def _(spark, sf):
    ink = F.aggregate("t", F.lit(0).cast("long"), lambda s, v: s + v)
    return masks(spark, sf).groupBy("img").agg(F.countDistinct("t").alias("kinds"), F.count("*").alias("n"), F.count_if(ink == 16).alias("solid"))


_SHAPE = f"{RGB}, shape AS (SELECT img, x // 4 AS tx, y // 4 AS ty, sum((1 << ((y % 4) * 4 + x % 4)::INT) * (r > 200)::INT) AS bits, sum((r > 200)::INT) AS ink FROM rgb GROUP BY ALL HAVING count(*) = 16)"


@query("seg06_identical_shapes", f"WITH {_SHAPE} SELECT CAST(bits AS BIGINT) AS bits, count(*) AS uses, CAST(max(ink) AS BIGINT) AS ink, CAST((count(*) - 1) * 20 - 30 AS BIGINT) AS saving FROM shape WHERE ink > 0 GROUP BY bits HAVING (count(*) - 1) * 20 - 30 > 0")
def _(spark, sf):
    """Shapes by their bitmap, those that pay for a dictionary entry."""
    on = F.col("r") > 200
    bit = F.call_function("shiftleft", F.lit(1), F.expr("int((y % 4) * 4 + x % 4)"))
    shape = planes.rgb8(spark, sf).groupBy("img", *tile()).agg(F.sum(F.when(on, bit).otherwise(0)).alias("bits"), F.count_if(on).alias("ink"), F.count("*").alias("m")).filter("m = 16 and ink > 0")
    g = shape.groupBy("bits").agg(F.count("*").alias("uses"), F.max("ink").alias("ink"))
    return g.withColumn("saving", (F.col("uses") - 1) * 20 - 30).filter("saving > 0")


@query("join06_equal_tiles", f"WITH {RGB}, {_TILE}, g AS (SELECT t, min(img * 1000 + ty * 8 + tx) AS leader, count(*) AS uses FROM tile GROUP BY t HAVING count(*) > 1) SELECT img, tx, ty, leader, uses FROM tile JOIN g USING (t)")
def _(spark, sf):
    """Each tile that has a twin, with the first of its kind: tiles meet by hash, and the samples themselves decide."""
    t = masks(spark, sf).withColumn("h", F.xxhash64("t"))
    g = t.groupBy("h", F.col("t").alias("own")).agg(F.min(F.expr("img * 1000 + ty * 8 + tx")).alias("leader"), F.count("*").alias("uses")).filter("uses > 1")
    return t.join(g, "h").filter("t = own").select("img", "tx", "ty", "leader", "uses")


_SIGN = f"{LONG}, sig AS (SELECT img, x // 8 AS tx, y // 8 AS ty, CAST(sum(v) FILTER (WHERE c = 0) AS BIGINT) AS s0, CAST(sum(v) FILTER (WHERE c = 1) AS BIGINT) AS s1, CAST(sum(v) FILTER (WHERE c = 2) AS BIGINT) AS s2, count(*) // 3 AS n FROM ch GROUP BY ALL)"
_NEAR = " AND ".join(f"abs(a.s{c} * b.n - b.s{c} * a.n) <= 2 * a.n * b.n" for c in range(3))


@query("join07_near_tiles", f"""WITH {_SIGN}, k AS (SELECT s0, s1, s2, n, min(img * 100 + ty * 10 + tx) AS id, count(*) AS uses FROM sig GROUP BY ALL) SELECT a.id AS a, b.id AS b, a.uses * b.uses AS links FROM k a JOIN k b ON a.id < b.id AND {_NEAR}""")
def _(spark, sf):
    """Kinds of tiles within 2 of each other in all three means. Equal tiles are one kind, told by its first and counted, so they
    yield no square; a kind stands in one bucket and its partners in the buckets around it in every mean, so near ones meet by an
    equi-join whatever side of a border they lie on. Sums are compared, not means, so nothing is rounded."""
    m = lambda c: F.sum(F.when(F.col("c") == c, F.col("v")))
    sig = raw_channels(spark, sf).groupBy("img", F.expr("x div 8").alias("tx"), F.expr("y div 8").alias("ty")).agg(*[m(c).alias(f"s{c}") for c in range(3)], F.expr("count(*) div 3").alias("n"))
    k = sig.groupBy("s0", "s1", "s2", "n").agg(F.min(F.expr("img * 100 + ty * 10 + tx")).alias("id"), F.count("*").alias("uses"))
    own = k.select("*", *[F.floor(F.col(f"s{c}") / (F.col("n") * 2)).alias(f"q{c}") for c in range(3)])
    other = own.select(F.col("id").alias("b"), F.col("uses").alias("others"), F.col("n").alias("m"), *[F.col(f"s{c}").alias(f"t{c}") for c in range(3)], "q0", "q1", "q2")
    for c in range(3):
        other = other.withColumn(f"q{c}", F.explode(F.array(*[F.col(f"q{c}") + d for d in (-1, 0, 1)])))
    near = " and ".join(f"abs(s{c} * m - t{c} * n) <= 2 * n * m" for c in range(3))
    return own.join(other, ["q0", "q1", "q2"]).filter(f"id < b and {near}").select(F.col("id").alias("a"), "b", (F.col("uses") * F.col("others")).alias("links"))


@query("join09_unpatched_residual", f"""WITH {RGB}, {_TILE}, g AS (SELECT t FROM tile GROUP BY t HAVING count(*) >= 5), cov AS (SELECT img, tx, ty FROM tile JOIN g USING (t))
SELECT rgb.img, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS rest FROM rgb WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.img = rgb.img AND cov.tx = rgb.x // 4 AND cov.ty = rgb.y // 4) GROUP BY rgb.img""")
def _(spark, sf):
    t = masks(spark, sf)
    shared = t.groupBy("t").agg(F.count("*").alias("n")).filter("n >= 5").select("t")
    covered = t.join(shared, "t", "left_semi").select("img", "tx", "ty")
    px = planes.rgb8(spark, sf).withColumns({"tx": F.expr("x div 4"), "ty": F.expr("y div 4")})
    return px.join(covered, ["img", "tx", "ty"], "left_anti").groupBy("img").agg(F.count("*").alias("pixels"), F.sum("r").alias("rest"))


@query("seg07_lattice_period", f"""WITH {LONG}, g AS (SELECT img, x, y, v FROM ch WHERE c = 1 AND y % 4 = 0), k AS (SELECT a.img, k, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * CAST(sum(b.v * b.v) AS DOUBLE)) AS r FROM range(1, 17) AS t(k), g a JOIN g b ON a.img = b.img AND a.y = b.y AND b.x = a.x + k GROUP BY a.img, k),
p AS (SELECT *, lag(r) OVER w AS r0, lead(r) OVER w AS r1 FROM k WINDOW w AS (PARTITION BY img ORDER BY k)) SELECT img, min(k) FILTER (WHERE k >= 4 AND r >= 0.5 AND r > r0 AND r >= r1) AS period FROM p GROUP BY img""")
def _(spark, sf):
    g = raw_channels(spark, sf).filter("c = 1 and y % 4 = 0")
    row = W.partitionBy("img", "y").orderBy("x")
    ahead = g.select("img", "v", F.array(*[F.lead("v", k).over(row) for k in range(1, 17)]).alias("ahead"))
    s = ahead.select("img", "v", F.posexplode("ahead").alias("k", "b")).filter("b is not null").withColumn("k", F.col("k") + 1)
    r = s.groupBy("img", "k").agg((F.sum(F.col("v") * F.col("b")) / F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("b") * F.col("b")).cast("double"))).alias("r"))
    w = W.partitionBy("img").orderBy("k")
    p = r.withColumns({"r0": F.lag("r").over(w), "r1": F.lead("r").over(w)})
    return p.groupBy("img").agg(F.min(F.when(F.expr("k >= 4 and r >= 0.5 and r > r0 and r >= r1"), F.col("k"))).cast("long").alias("period"))


@query("seg10_cell_layer", f"""WITH {LONG}, q AS (SELECT img, x, y, (r > 200)::INT AS v FROM rgb), s AS (SELECT img, x, y, v, sum(h) OVER (PARTITION BY img, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM (SELECT *, sum(v) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM q))
SELECT img, count(*) AS cells, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s WHERE v = 1 AND around >= 6 GROUP BY img""")
def _(spark, sf):
    row, col = (W.partitionBy("img", a).orderBy(b).rowsBetween(-2, 2) for a, b in (("y", "x"), ("x", "y")))
    q = planes.rgb8(spark, sf).select("img", "x", "y", (F.col("r") > 200).cast("int").alias("v"))
    s = q.withColumn("h", F.sum("v").over(row)).withColumn("around", F.sum("h").over(col)).filter("v = 1 and around >= 6")
    return s.groupBy("img").agg(F.count("*").alias("cells"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("seg13_bilinear_samples", f"""WITH {LONG}, t AS (SELECT img, c, x, y, v AS a, {_tap_sql(1, 0)} AS b, {_tap_sql(0, 1)} AS d, {_tap_sql(1, 1)} AS e FROM ch) SELECT img, c, x, y, round((a * 0.75 + b * 0.25) * 0.5 + (d * 0.75 + e * 0.25) * 0.5, 6) AS v FROM t WHERE e IS NOT NULL""")
def _(spark, sf):
    t = raw_channels(spark, sf).select("img", "c", "x", "y", F.col("v").alias("a"), tap(1, 0).alias("b"), tap(0, 1).alias("d"), tap(1, 1).alias("e")).filter("e is not null")
    return t.select("img", "c", "x", "y", F.round(F.expr("(a * 0.75D + b * 0.25D) * 0.5D + (d * 0.75D + e * 0.25D) * 0.5D"), 6).alias("v"))


@query("seg05_pitch_votes", f"""WITH {RGB}, e AS (SELECT img, y, x, x - lag(x) OVER (PARTITION BY img, y ORDER BY x) AS gap FROM rgb WHERE r > 200) SELECT img, gap AS pitch, count(*) AS votes FROM e WHERE gap IS NOT NULL AND gap >= 2 GROUP BY img, gap""")
def _(spark, sf):
    e = planes.rgb8(spark, sf).filter("r > 200").select("img", (F.col("x") - F.lag("x").over(W.partitionBy("img", "y").orderBy("x"))).alias("pitch"))
    return e.filter("pitch >= 2").groupBy("img", "pitch").agg(F.count("*").alias("votes"))


# orders -----------------------------------------------------------------------------------------------------------


@query("ord01_stable_sort", f"WITH {RGB} SELECT img, i, row_number() OVER (PARTITION BY img ORDER BY g, r DESC, i) AS place FROM rgb")
def _(spark, sf):
    return planes.rgb8(spark, sf).select("img", "i", F.row_number().over(W.partitionBy("img").orderBy("g", F.desc("r"), "i")).alias("place"))


@query("ord02_top_candidates", f"WITH {RGB}, s AS (SELECT img, r, count(*) AS n FROM rgb GROUP BY ALL) SELECT img, r, n, k FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, r) AS k FROM s) WHERE k <= 7")
def _(spark, sf):
    s = planes.rgb8(spark, sf).groupBy("img", "r").agg(F.count("*").alias("n"))
    return s.withColumn("k", F.row_number().over(W.partitionBy("img").orderBy(F.desc("n"), "r"))).filter("k <= 7")


@query("ord03_palette_orders", f"""WITH {_INDEX}, t AS (SELECT *, r - b AS co, b + ((r - b) >> 1) AS t FROM idx), y AS (SELECT *, g - t AS cg, t + ((g - t) >> 1) AS yy FROM t)
SELECT img, k, row_number() OVER (PARTITION BY img ORDER BY co, cg, yy) - 1 AS chroma_place, row_number() OVER (PARTITION BY img ORDER BY yy, co, cg) - 1 AS luma_place FROM y""")
def _(spark, sf):
    y, co, cg = color.ycocg(F.col("r"), F.col("g"), F.col("b"))
    p = palette_index(spark, sf).select("img", "k", y.alias("y"), co.alias("co"), cg.alias("cg"))
    place = lambda *by: (F.row_number().over(W.partitionBy("img").orderBy(*by)) - 1).cast("long")
    return p.select("img", "k", place("co", "cg", "y").alias("chroma_place"), place("y", "co", "cg").alias("luma_place"))


@query("ord04_serpentine", f"WITH {RGB} SELECT img, i, row_number() OVER (PARTITION BY img ORDER BY y, CASE WHEN y % 2 = 0 THEN x ELSE -x END) - 1 AS place FROM rgb")
def _(spark, sf):
    along = F.when(F.col("y") % 2 == 0, F.col("x")).otherwise(-F.col("x"))
    return planes.rgb8(spark, sf).select("img", "i", (F.row_number().over(W.partitionBy("img").orderBy("y", along)) - 1).cast("long").alias("place"))


@query("ord06_lehmer_codes", """WITH p AS (SELECT o_orderkey // 32 AS g, o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 32 ORDER BY o_orderkey) AS pos, row_number() OVER (PARTITION BY o_orderkey // 32 ORDER BY o_totalprice, o_orderkey) AS rank FROM orders)
SELECT a.g, a.pos, (SELECT count(*) FROM p b WHERE b.g = a.g AND b.pos > a.pos AND b.rank < a.rank) AS code FROM p a""")
def _(spark, sf):
    """How many later elements are smaller, within permutations of bounded length: each is one array, nothing is joined."""
    o = planes.table(spark, sf, "orders").select(F.expr("o_orderkey div 32").alias("g"), "o_orderkey", "o_totalprice")
    ranked = o.select("g", F.row_number().over(W.partitionBy("g").orderBy("o_orderkey")).alias("pos"), F.row_number().over(W.partitionBy("g").orderBy("o_totalprice", "o_orderkey")).alias("rank"))
    p = ranked.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("p"))  # 32 at most
    code = lambda e: F.struct(e["pos"].alias("pos"), F.size(F.filter("p", lambda o: (o["pos"] > e["pos"]) & (o["rank"] < e["rank"]))).cast("long").alias("code"))
    return p.select("g", F.explode(F.transform("p", code)).alias("e")).select("g", "e.*")


@query("ord07_group_order", f"WITH {RGB}, t AS (SELECT img, x // 8 AS gx, y // 8 AS gy FROM rgb GROUP BY ALL) SELECT img, gx, gy, row_number() OVER (PARTITION BY img ORDER BY greatest(abs(gx - 2), abs(gy - 1)), gy, gx) - 1 AS place FROM t")
def _(spark, sf):
    """Rings around the middle group first."""
    t = planes.rgb8(spark, sf).select("img", F.expr("x div 8").alias("gx"), F.expr("y div 8").alias("gy")).distinct()
    ring = F.greatest(F.abs(F.col("gx") - 2), F.abs(F.col("gy") - 1))
    return t.withColumn("place", (F.row_number().over(W.partitionBy("img").orderBy(ring, "gy", "gx")) - 1).cast("long"))


_MORTON = " + ".join(f"(((x >> {k}) & 1) << {2 * k}) + (((y >> {k}) & 1) << {2 * k + 1})" for k in range(6))


@query("ord08_morton", f"WITH {RGB} SELECT img, i, {_MORTON} AS code FROM rgb")
def _(spark, sf):
    bit = lambda c, k, to: F.shiftleft(F.shiftright(F.col(c), k).bitwiseAND(F.lit(1)), to)
    terms = [bit("x", k, 2 * k) + bit("y", k, 2 * k + 1) for k in range(6)]
    return planes.rgb8(spark, sf).select("img", "i", sum(terms[1:], terms[0]).alias("code"))


@query("ord10_strided_sample", f"WITH {RGB} SELECT img, i, r FROM rgb WHERE i % 16 = 5")
def _(spark, sf):
    return planes.rgb8(spark, sf).filter("i % 16 = 5").select("img", "i", "r")


@query("set01_distinct_colors", f"WITH {RGB} SELECT DISTINCT r, g, b FROM rgb")
def _(spark, sf):
    return planes.rgb8(spark, sf).select("r", "g", "b").distinct()


@query("set02_template_union", f"WITH {_SHAPE} SELECT DISTINCT bits::BIGINT AS bits FROM shape WHERE img % 2 = 0 UNION SELECT bits::BIGINT FROM shape WHERE ink > 8")
def _(spark, sf):
    on = F.col("r") > 200
    bit = F.call_function("shiftleft", F.lit(1), F.expr("int((y % 4) * 4 + x % 4)"))
    shape = planes.rgb8(spark, sf).groupBy("img", *tile()).agg(F.sum(F.when(on, bit).otherwise(0)).alias("bits"), F.count_if(on).alias("ink"), F.count("*").alias("m")).filter("m = 16")
    return shape.filter((F.col("img") % 2 == 0) | (F.col("ink") > 8)).select("bits").distinct()


@query("set03_merged_spans", """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 30 AS b FROM orders), m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS span FROM m) SELECT o_custkey, CAST(span AS BIGINT) AS span, count(*) AS merged, CAST(max(b) - min(a) AS BIGINT) AS days FROM i GROUP BY o_custkey, span""")
def _(spark, sf):
    """Spans joined for as long as any overlap: in order of their starts a new one begins where none before reaches; no join, no rounds."""
    start = F.col("o_orderdate").cast("date")
    o = planes.table(spark, sf, "orders").select("o_custkey", start.alias("a"), F.date_add(start, 30).alias("b"))
    w = W.partitionBy("o_custkey").orderBy("a", "b")
    m = o.withColumn("reach", F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)))
    i = m.withColumn("span", F.sum(F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return i.groupBy("o_custkey", "span").agg(F.count("*").alias("merged"), F.datediff(F.max("b"), F.min("a")).cast("long").alias("days"))
