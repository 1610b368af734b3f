"""Queries of content classifiers, filters and gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.operators.predict import tap
from mosaicq.plans.catalog import query
from mosaicq.plans.rows import xyb_pixels
from mosaicq.plans.sql import LONG, RGB, SIGNAL, XYB
from mosaicq.plans.windows import _tap_sql, raw_channels
from mosaicq.sources import planes



def site():
    """The 8x8 site of a pixel."""
    return F.expr("x div 8").alias("bx"), F.expr("y div 8").alias("bv")


@query("flt01_constant_blocks", f"""WITH {RGB}, s AS (SELECT img, x // 8 AS bx, y // 8 AS bv, min(r // 32) = max(r // 32) AND min(g // 128) = max(g // 128) AND min(b // 128) = max(b // 128) AS flat FROM rgb GROUP BY ALL)
SELECT img, round(avg(flat::INT), 6) AS share, avg(flat::INT) >= 0.15 AS screen FROM s GROUP BY img""")
def _(spark, sf):
    """Blocks whose coarse colours don't change."""
    flat = F.lit(True)
    for c, k in (("r", 32), ("g", 128), ("b", 128)):
        q = F.expr(f"{c} div {k}")
        flat = flat & (F.min(q) == F.max(q))
    s = planes.rgb8(spark, sf).groupBy("img", *site()).agg(flat.cast("int").alias("flat"))
    return s.groupBy("img").agg(F.round(F.avg("flat"), 6).alias("share"), (F.avg("flat") >= 0.15).alias("screen"))


@query("flt02_cell_factor", f"""WITH {RGB}, f AS (SELECT * FROM (VALUES (2), (4), (8)) AS t(f)), s AS (SELECT img, f, x // f AS bx, y // f AS bv, min(b // 64) = max(b // 64) AS flat FROM rgb, f GROUP BY ALL), a AS (SELECT img, f, avg(flat::INT) AS share FROM s GROUP BY img, f)
SELECT img, CAST(coalesce(max(f) FILTER (WHERE share >= 0.01), 1) AS BIGINT) AS factor FROM a GROUP BY img""")
def _(spark, sf):
    px = planes.rgb8(spark, sf).select("img", "x", "y", F.expr("b div 64").alias("v"))
    each = px.withColumn("f", F.explode(F.array(F.lit(2), F.lit(4), F.lit(8))))
    s = each.groupBy("img", "f", F.expr("x div f").alias("bx"), F.expr("y div f").alias("bv")).agg((F.min("v") == F.max("v")).cast("int").alias("flat"))
    a = s.groupBy("img", "f").agg(F.avg("flat").alias("share"))
    return a.groupBy("img").agg(F.coalesce(F.max(F.when(F.col("share") >= 0.01, F.col("f"))), F.lit(1)).cast("long").alias("factor"))


@query("flt03_solid_alpha", f"WITH {RGB} SELECT img, min(a) AS least, max(a) AS most, min(a) = max(a) AS solid FROM rgb GROUP BY img")
def _(spark, sf):
    return planes.rgb8(spark, sf).groupBy("img").agg(F.min("a").alias("least"), F.max("a").alias("most"), (F.min("a") == F.max("a")).alias("solid"))


@query("flt04_textured_share", f"WITH {RGB}, s AS (SELECT img, x // 8 AS bx, y // 8 AS bv, count(DISTINCT (77 * r + 150 * g + 29 * b) >> 8) AS levels FROM rgb GROUP BY ALL) SELECT img, round(avg((levels >= 12)::INT), 6) AS share FROM s GROUP BY img")
def _(spark, sf):
    luma = F.shiftright(F.expr("77 * r + 150 * g + 29 * b"), 8)
    s = planes.rgb8(spark, sf).groupBy("img", *site()).agg(F.countDistinct(luma).alias("levels"))
    return s.groupBy("img").agg(F.round(F.avg((F.col("levels") >= 12).cast("int")), 6).alias("share"))


_FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


@query("flt05_flat_tiles", f"""WITH {LONG}, q AS (SELECT img, c, i, x, y, v // 32 AS v FROM ch WHERE c = 0), t AS (SELECT *, {', '.join(f'coalesce({_tap_sql(*o)}, v) AS t{k}' for k, o in enumerate(_FOUR))} FROM q)
SELECT img, x // 8 AS bx, y // 8 AS bv, CAST(sum(((t0 = v)::INT + (t1 = v)::INT + (t2 = v)::INT + (t3 = v)::INT >= 2)::INT) AS BIGINT) AS flat, count(*) AS n FROM t GROUP BY img, x // 8, y // 8""")
def _(spark, sf):
    q = raw_channels(spark, sf).filter("c = 0").withColumn("v", F.expr("v div 32"))
    t = q.select("img", "x", "y", "v", "i", "c", *[F.coalesce(tap(*o), F.col("v")).alias(f"t{k}") for k, o in enumerate(_FOUR)])
    same = sum(((F.col(f"t{k}") == F.col("v")).cast("int") for k in range(1, 4)), (F.col("t0") == F.col("v")).cast("int"))
    return t.groupBy("img", *site()).agg(F.count_if(same >= 2).alias("flat"), F.count("*").alias("n"))


@query("flt06_rich_tiles", f"""WITH {RGB}, k AS (SELECT img, x, y, r * 65536 + g * 256 + b AS k FROM rgb), u AS (SELECT img, k, count(*) AS uses FROM k GROUP BY ALL)
SELECT img, x // 8 AS bx, y // 8 AS bv, round(avg((uses < 2)::INT), 6) AS rare, round(count(DISTINCT k) / CAST(count(*) AS DOUBLE), 6) AS variety, avg((uses < 2)::INT) >= 0.3 OR count(DISTINCT k) / CAST(count(*) AS DOUBLE) >= 0.95 AS rich FROM k JOIN u USING (img, k) GROUP BY img, x // 8, y // 8""")
def _(spark, sf):
    """A colour's uses come from a window over its image's pixels of that colour: nothing is joined back."""
    k = planes.rgb8(spark, sf).select("img", "x", "y", F.expr("r * 65536 + g * 256 + b").alias("k"))
    k = k.withColumn("uses", F.count("*").over(W.partitionBy("img", "k")))
    rare, variety = F.avg((F.col("uses") < 2).cast("int")), F.countDistinct("k") / F.count("*").cast("double")
    return k.groupBy("img", *site()).agg(F.round(rare, 6).alias("rare"), F.round(variety, 6).alias("variety"), ((rare >= 0.3) | (variety >= 0.95)).alias("rich"))


@query("flt07_equality_maps", f"""WITH {LONG}, l AS (SELECT img, i, x, y, (77 * r + 150 * g + 29 * b) >> 8 AS v, 0 AS c FROM rgb) SELECT img, i, coalesce({_tap_sql(1, 0)} = v, false) AS right_same, coalesce({_tap_sql(0, 1)} = v, false) AS below_same FROM l""")
def _(spark, sf):
    v = F.shiftright(F.expr("77 * r + 150 * g + 29 * b"), 8)
    px = planes.rgb8(spark, sf).select("img", "i", "x", F.lit(0).alias("c"), v.alias("v"))
    return px.select("img", "i", F.coalesce(tap(1, 0) == F.col("v"), F.lit(False)).alias("right_same"), F.coalesce(tap(0, 1) == F.col("v"), F.lit(False)).alias("below_same"))


@query("flt08_chroma_statistics", f"""WITH {RGB}, s AS (SELECT img, x, y, greatest(r, g, b) - least(r, g, b) AS sat, greatest(r, g, b) < 64 AS dark FROM rgb WHERE x % 4 = 0 AND y % 4 = 0)
SELECT img, count(*) AS n, round(avg(sat), 6) AS saturation, round(avg(dark::INT), 6) AS dark FROM s GROUP BY img""")
def _(spark, sf):
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    s = planes.rgb8(spark, sf).filter("x % 4 = 0 and y % 4 = 0")
    return s.groupBy("img").agg(F.count("*").alias("n"), F.round(F.avg(top - low), 6).alias("saturation"), F.round(F.avg((top < 64).cast("int")), 6).alias("dark"))


@query("flt09_gradient_ratios", f"""WITH {XYB}, t AS (SELECT img, y, abs(xx - lag(xx) OVER w) AS dx, abs(yy - lag(yy) OVER w) AS dy, abs(bb - yy - lag(bb - yy) OVER w) AS db FROM xyb WINDOW w AS (PARTITION BY img, y ORDER BY x))
SELECT img, round(sum(dx) / sum(dy), 6) AS x_ratio, round(sum(db) / sum(dy), 6) AS b_ratio FROM t WHERE y % 4 = 0 GROUP BY img""")
def _(spark, sf):
    row = W.partitionBy("img", "y").orderBy("x")
    step = lambda e: F.abs(e - F.lag(e).over(row))
    t = xyb_pixels(spark, sf).filter("y % 4 = 0").select("img", step(F.col("xx")).alias("dx"), step(F.col("yy")).alias("dy"), step(F.col("bb") - F.col("yy")).alias("db"))
    return t.groupBy("img").agg(F.round(F.sum("dx") / F.sum("dy"), 6).alias("x_ratio"), F.round(F.sum("db") / F.sum("dy"), 6).alias("b_ratio"))


@query("flt10_chroma_steps", f"""WITH {XYB}, t AS (SELECT img, abs(xx - lag(xx, 4) OVER w) AS d FROM xyb WINDOW w AS (PARTITION BY img, y ORDER BY x))
SELECT img, {', '.join(f'count(*) FILTER (WHERE d > {k / 100}) AS over{k}' for k in (1, 2, 4))} FROM t GROUP BY img""")
def _(spark, sf):
    t = xyb_pixels(spark, sf).select("img", F.abs(F.col("xx") - F.lag("xx", 4).over(W.partitionBy("img", "y").orderBy("x"))).alias("d"))
    return t.groupBy("img").agg(*[F.count_if(F.col("d") > k / 100).alias(f"over{k}") for k in (1, 2, 4)])


@query("flt11_yellow_risk", f"WITH {RGB} SELECT img, round(avg((r > 150 AND g > 150 AND b < 100)::INT), 6) AS yellow, round(avg((r > 180 AND g < 100 AND b < 100)::INT), 6) AS red, avg((r > 150 AND g > 150 AND b < 100)::INT) > 0.05 AS risky FROM rgb GROUP BY img")
def _(spark, sf):
    yellow, red = F.avg(F.expr("r > 150 and g > 150 and b < 100").cast("int")), F.avg(F.expr("r > 180 and g < 100 and b < 100").cast("int"))
    return planes.rgb8(spark, sf).groupBy("img").agg(F.round(yellow, 6).alias("yellow"), F.round(red, 6).alias("red"), (yellow > 0.05).alias("risky"))


@query("flt12_few_colors", f"""WITH {XYB}, q AS (SELECT img, x // 8 AS bx, y // 8 AS bv, round(xx * 1024) AS a, round(yy * 1024) AS b, round(bb * 1024) AS c FROM xyb) SELECT img, bx, bv, count(DISTINCT (a, b, c)) AS colors, count(DISTINCT (a, b, c)) <= 24 AS few FROM q GROUP BY img, bx, bv""")
def _(spark, sf):
    n = F.countDistinct(*[F.round(F.col(c) * 1024) for c in ("xx", "yy", "bb")])
    return xyb_pixels(spark, sf).groupBy("img", *site()).agg(n.alias("colors"), (n <= 24).alias("few"))


@query("flt13_tile_energy", f"""WITH {LONG}, m AS (SELECT *, avg(v) OVER (PARTITION BY img, c, x // 8, y // 8) AS m FROM ch) SELECT img, c, x // 8 AS bx, y // 8 AS bv, round(avg(abs(v - m)) / 255, 6) AS energy, avg(abs(v - m)) / 255 >= 0.017 AS kept FROM m GROUP BY img, c, x // 8, y // 8""")
def _(spark, sf):
    t = raw_channels(spark, sf).withColumns({"bx": F.expr("x div 8"), "bv": F.expr("y div 8")})
    t = t.withColumn("m", F.avg("v").over(W.partitionBy("img", "c", "bx", "bv")))
    e = F.avg(F.abs(F.col("v") - F.col("m"))) / 255
    return t.groupBy("img", "c", "bx", "bv").agg(F.round(e, 6).alias("energy"), (e >= 0.017).alias("kept"))


_MODES = f"{RGB}, k AS (SELECT img, x, y, x // 8 AS tx, y // 8 AS ty, b AS k FROM rgb), h AS (SELECT img, tx, ty, k, count(*) AS n FROM k GROUP BY ALL), modal AS (SELECT img, tx, ty, k AS back FROM (SELECT *, row_number() OVER (PARTITION BY img, tx, ty ORDER BY n DESC, k) AS r FROM h) WHERE r = 1)"


@query("flt14_ink_mask", f"""WITH {_MODES}, ink AS (SELECT k.img, x, y FROM k WHERE NOT EXISTS (SELECT 1 FROM modal m WHERE m.img = k.img AND abs(m.tx - k.tx) <= 1 AND abs(m.ty - k.ty) <= 1 AND m.back = k.k)) SELECT img, count(*) AS ink, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM ink GROUP BY img""")
def _(spark, sf):
    """Modal colours of a tile and its eight neighbours go to the tiles that test against them, one list a tile."""
    k = planes.rgb8(spark, sf).select("img", "x", "y", F.expr("x div 8").alias("tx"), F.expr("y div 8").alias("ty"), F.col("b").alias("k"))
    modal = k.groupBy("img", "tx", "ty", "k").agg(F.count("*").alias("n")).groupBy("img", "tx", "ty").agg(F.min(F.struct((-F.col("n")).alias("n"), "k"))["k"].alias("back"))
    step = F.sequence(F.lit(-1), F.lit(1))
    spread = modal.select("img", "ty", "back", F.explode(F.transform(step, lambda d: F.col("tx") + d)).alias("tx")).select("img", "tx", "back", F.explode(F.transform(step, lambda d: F.col("ty") + d)).alias("ty"))
    around = spread.groupBy("img", "tx", "ty").agg(F.collect_set("back").alias("backs"))  # nine at most
    ink = k.join(around, ["img", "tx", "ty"]).filter(~F.array_contains("backs", F.col("k")))
    return ink.groupBy("img").agg(F.count("*").alias("ink"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("flt15_thin_ridges", f"""WITH {LONG}, t AS (SELECT *, {', '.join(f'coalesce({_tap_sql(*o)}, {_tap_sql(-o[0], -o[1])}) AS t{k}' for k, o in enumerate(_FOUR))} FROM ch WHERE c = 0)
SELECT img, count(*) AS tested, count(*) FILTER (WHERE (abs(t0 - t1) <= 10 AND abs(v - t0) >= 60) OR (abs(t2 - t3) <= 10 AND abs(v - t2) >= 60)) AS ridges FROM t WHERE (x + y) % 2 = 0 GROUP BY img""")
def _(spark, sf):
    """At an edge the side that exists stands for both."""
    t = raw_channels(spark, sf).filter("c = 0").select("img", "x", "y", "v", "i", "c", *[F.coalesce(tap(*o), tap(-o[0], -o[1])).alias(f"t{k}") for k, o in enumerate(_FOUR)])
    thin = F.expr("(abs(t0 - t1) <= 10 and abs(v - t0) >= 60) or (abs(t2 - t3) <= 10 and abs(v - t2) >= 60)")
    return t.filter("(x + y) % 2 = 0").groupBy("img").agg(F.count("*").alias("tested"), F.count_if(thin).alias("ridges"))


@query("flt16_flat_patches", f"""WITH {LONG}, p AS (SELECT img, x // 8 AS bx, y // 8 AS bv, avg(v) AS m, avg(abs(v - w)) AS score FROM (SELECT *, coalesce({_tap_sql(-1, 0)}, v) AS w FROM ch WHERE c = 1) GROUP BY ALL), q AS (SELECT *, CAST(floor(m / 64) AS BIGINT) AS bin, CAST(floor(score / 8) AS BIGINT) AS level FROM p),
h AS (SELECT bin, level, count(*) AS n FROM q GROUP BY ALL), modal AS (SELECT bin, level AS mode FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n DESC, level) AS r FROM h) WHERE r = 1)
SELECT bin, mode, count(*) AS patches, count(*) FILTER (WHERE score < (mode + 1) * 8) AS flat FROM q JOIN modal USING (bin) GROUP BY bin, mode""")
def _(spark, sf):
    """Patches below the edge of their intensity's most frequent score level; levels of a bin are few, patches any number."""
    t = raw_channels(spark, sf).filter("c = 1").select("img", "x", "y", "v", "i", "c", F.coalesce(tap(-1, 0), F.col("v")).alias("w"))
    p = t.groupBy("img", *site()).agg(F.avg("v").alias("m"), F.avg(F.abs(F.col("v") - F.col("w"))).alias("score"))
    h = p.groupBy(F.floor(F.col("m") / 64).alias("bin"), F.floor(F.col("score") / 8).alias("level")).agg(F.count("*").alias("n"))
    mode = F.min(F.struct((-F.col("n")).alias("n"), "level")).over(W.partitionBy("bin"))["level"]
    return h.withColumn("mode", mode).groupBy("bin", "mode").agg(F.sum("n").alias("patches"), F.sum(F.when(F.col("level") <= F.col("mode"), F.col("n")).otherwise(0)).alias("flat"))


# The tiers of effort and what each switches on.
TIERS = [("fastest", 0, False, False, 1), ("fast", 1, False, False, 2), ("medium", 2, True, False, 4), ("slow", 3, True, True, 8), ("extra", 4, True, True, 16)]


@query("flt18_effort_gates", f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {k}, {str(p).lower()}, {str(s).lower()}, {r})" for n, k, p, s, r in TIERS)}) AS t(name, tier, patches, splines, rounds)), u AS (SELECT c_custkey % 5 AS tier, count(*) AS jobs FROM customer GROUP BY ALL)
SELECT name, jobs, patches, splines, jobs * rounds AS work FROM t JOIN u USING (tier)""")
def _(spark, sf):
    t = spark.createDataFrame(TIERS, "name string, tier long, patches boolean, splines boolean, rounds long")
    u = planes.table(spark, sf, "customer").groupBy((F.col("c_custkey") % 5).alias("tier")).agg(F.count("*").alias("jobs"))
    return u.join(F.broadcast(t), "tier").select("name", "jobs", "patches", "splines", (F.col("jobs") * F.col("rounds")).alias("work"))


@query("str01_progressive_passes", f"WITH {SIGNAL} SELECT user_id, s AS shift, CAST(sum((v >> s) - CASE WHEN s < 12 THEN (v >> (s + 4)) << 4 ELSE 0 END) AS BIGINT) AS detail FROM sig, (VALUES (12), (8), (4), (0)) AS p(s) GROUP BY user_id, s")
def _(spark, sf):
    """Successive passes add four bits each to what the passes before have shown."""
    v = F.col("v")
    parts = [F.struct(F.lit(s).alias("shift"), (F.shiftright(v, s) - (F.shiftleft(F.shiftright(v, s + 4), 4) if s < 12 else 0)).alias("d")) for s in (12, 8, 4, 0)]
    return planes.signal(spark, sf).select("user_id", F.explode(F.array(*parts)).alias("p")).groupBy("user_id", "p.shift").agg(F.sum("p.d").alias("detail"))
