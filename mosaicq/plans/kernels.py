"""Queries that run a sequential kernel per group: an image's channel, a stream or a block. Round trips have an oracle."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.operators import kernels as k
from mosaicq.operators.groups import by_groups, column, lengths
from mosaicq.plans.catalog import query
from mosaicq.plans.sql import LETTERS, LONG, RGB, SIGNAL, YCC
from mosaicq.plans.windows import raw_channels, ycc_pixels
from mosaicq.sources import planes

WIDTH = planes.WIDTH


def plane_of(pdf: pd.DataFrame, column: str = "v", fill: int = 0) -> np.ndarray:
    """A group's plane, all of it: what its last row lacks is filled. In raster order the samples come first."""
    v = pdf.sort_values("i")[column].to_numpy()
    return np.concatenate((v, np.full(-len(v) % WIDTH, fill, v.dtype))).reshape(-1, WIDTH)


def mask_of(pdf: pd.DataFrame) -> np.ndarray:
    """The pixels of a group as a mask as high as they reach."""
    mask = np.zeros((int(pdf.y.max()) + 1, WIDTH), bool)
    mask[pdf.y, pdf.x] = True
    return mask


def whole_rows(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of many planes' samples in raster order, what the last ones lack filled with 0; each row's y; where each sample stands in them."""
    size = np.diff(starts, append=len(v))
    rows = -(-size // WIDTH)
    first = np.cumsum(rows) - rows
    at = np.arange(len(v)) + np.repeat(first * WIDTH - starts, size)
    out = np.zeros(int(rows.sum()) * WIDTH, v.dtype)
    out[at] = v
    return out.reshape(-1, WIDTH), np.arange(int(rows.sum())) - np.repeat(first, rows), at


@query("win03_weighted_predictor")
def _(spark, sf):
    """The planes of many images at once."""

    def run(px: pa.Table, starts: np.ndarray) -> dict:
        out = []
        for c in range(3):
            rows, y, at = whole_rows(column(px, f"c{c}"), starts)
            e = np.abs(k.weighted_residuals_of(rows, y).reshape(-1)[at])
            out.append((np.full(len(starts), c, np.int32), lengths(px, starts), np.add.reduceat(e, starts), np.maximum.reduceat(e, starts)))
        c, n, size, most = (np.concatenate(a) for a in zip(*out, strict=True))
        return {"img": pa.chunked_array([px["img"].combine_chunks().take(pa.array(starts))] * 3), "c": c, "samples": n, "size": size, "most": most}

    px = ycc_pixels(spark, sf).select("img", "i", "c0", "c1", "c2")
    return by_groups(px, ["img"], "i", run, "img long, c int, samples long, size long, most long")


@query("win07_squeeze_inverse", f"WITH {YCC} SELECT img, c, y, count(*) AS n, CAST(sum(v * (x + 1)) AS BIGINT) AS checksum FROM ych GROUP BY img, c, y")
def _(spark, sf):
    """Rows squeezed and restored, all of one length at once: the oracle knows only the rows."""

    def run(px: pa.Table, starts: np.ndarray) -> dict:
        n = lengths(px, starts)
        sums = np.zeros((3, len(starts)), np.int64)
        for c in range(3):
            v = column(px, f"c{c}")
            for length in np.unique(n).tolist():
                rows = np.flatnonzero(n == length)
                back = k.unsqueeze(*k.squeeze(v[starts[rows][:, None] + np.arange(length)]))
                sums[c, rows] = back @ np.arange(1, length + 1)
        key = {c: pa.chunked_array([px[c].combine_chunks().take(pa.array(starts))] * 3) for c in ("img", "y")}
        return {**key, "c": np.repeat(np.arange(3, dtype=np.int32), len(starts)), "n": np.tile(n, 3), "checksum": sums.reshape(-1)}

    px = ycc_pixels(spark, sf).select("img", "y", "i", "c0", "c1", "c2")
    return by_groups(px, ["img", "y"], "i", run, "img long, c int, y long, n long, checksum long")


def _histograms(spark, sf):
    return planes.letters(spark, sf).groupBy((F.col("stream") % 16).alias("ctx"), F.col("value").alias("sym")).agg(F.count("*").alias("n"))


def _counts(pdf: pd.DataFrame) -> list[int]:
    return np.bincount(pdf["sym"], pdf["n"], 256).astype(int).tolist()


@query("ent01_huffman_depths")
def _(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = _counts(pdf)
        d = k.huffman_depths(n)
        return pd.DataFrame({"ctx": pdf.ctx.iloc[0], "sym": np.arange(256), "n": n, "depth": d})[lambda t: t.n > 0]

    return _histograms(spark, sf).groupBy("ctx").applyInPandas(run, "ctx long, sym long, n long, depth long")


# The two lightest trees merge until one is left; what the merges weigh is what the code spends.
_MERGES = """m AS (SELECT ctx, list_sort(list(CAST(n AS BIGINT))) AS l, CAST(0 AS BIGINT) AS bits FROM h GROUP BY ctx
UNION ALL SELECT ctx, list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM m WHERE len(l) > 1)"""


@query("agg04_huffman_bits", f"""WITH RECURSIVE {LETTERS}, h AS (SELECT stream % 64 AS ctx, value AS sym, count(*) AS n FROM letters GROUP BY ALL), {_MERGES}, t AS (SELECT ctx, count(*) AS symbols, CAST(sum(n) AS BIGINT) AS total FROM h GROUP BY ctx)
SELECT ctx, symbols, total, CAST(max(CASE WHEN symbols = 1 THEN total ELSE bits END) AS BIGINT) AS bits FROM m JOIN t USING (ctx) GROUP BY ctx, symbols, total""")
def _(spark, sf):
    """What each context's symbols cost under its Huffman code: counts times depths, a lone symbol a bit each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = _counts(pdf)
        d = k.huffman_depths(n, 24)
        return pd.DataFrame({"ctx": [pdf.ctx.iloc[0]], "symbols": [sum(x > 0 for x in n)], "total": [sum(n)], "bits": [sum(a * b for a, b in zip(n, d, strict=True))]})

    h = planes.letters(spark, sf).groupBy((F.col("stream") % 64).alias("ctx"), F.col("value").alias("sym")).agg(F.count("*").alias("n"))
    return h.groupBy("ctx").applyInPandas(run, "ctx long, symbols long, total long, bits long")


# Counts scaled to the table of 4096: the first maximum takes what is missing; what is too much comes off the first maximum, one by one.
_SCALED = """t AS (SELECT ctx, sym, n, CAST(sum(n) OVER (PARTITION BY ctx) AS BIGINT) AS total FROM h), f AS (SELECT ctx, sym, n, greatest(1, n * 4096 // total) AS f0 FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY f0 DESC, sym) AS k, CAST(4096 - sum(f0) OVER (PARTITION BY ctx) AS BIGINT) AS rest FROM f),
s AS (SELECT ctx, sym, unnest(range(f0, f0 - least(f0 - 1, -rest), -1)) AS level FROM r WHERE rest < 0), o AS (SELECT ctx, sym, row_number() OVER (PARTITION BY ctx ORDER BY level DESC, sym) AS place FROM s),
less AS (SELECT ctx, sym, count(*) AS off FROM o JOIN (SELECT DISTINCT ctx, -rest AS many FROM r) USING (ctx) WHERE place <= many GROUP BY ctx, sym)"""


@query("ent04_exact_ans_counts", f"""WITH {LETTERS}, h AS (SELECT stream % 16 AS ctx, value AS sym, count(*) AS n FROM letters GROUP BY ALL), {_SCALED}
SELECT ctx, sym, n, CAST(f0 + CASE WHEN k = 1 AND rest > 0 THEN rest ELSE 0 END - coalesce(off, 0) AS BIGINT) AS freq FROM r LEFT JOIN less USING (ctx, sym)""")
def _(spark, sf):
    """Each context's counts scaled to the coder's table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = _counts(pdf)
        return pd.DataFrame({"ctx": pdf.ctx.iloc[0], "sym": np.arange(256), "n": n, "freq": k.ans_counts(n)})[lambda t: t.n > 0]

    return _histograms(spark, sf).groupBy("ctx").applyInPandas(run, "ctx long, sym long, n long, freq long")


@query("ent04_limited_counts", f"""WITH {LETTERS}, h AS (SELECT stream % 16 AS ctx, value // 16 AS sym, count(*) AS n FROM letters GROUP BY ALL), e AS (SELECT ctx, count(*) AS symbols, CASE WHEN count(*) = 1 THEN 0.0 ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END AS least FROM h GROUP BY ctx)
SELECT ctx, shift, symbols, CAST(4096 AS BIGINT) AS total, round(least, 2) AS least, true AS near FROM e, (VALUES (4), (8), (12)) AS s(shift)""")
def _(spark, sf):
    """Counts that a table can tell at three precisions, moved to where the data costs least: near the entropy at the finest, a fiftieth off at the coarsest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(pdf["sym"], pdf["n"], 16).astype(int).tolist()
        used = np.array([x for x in n if x], float)
        least = float(used.sum() * np.log2(used.sum()) - (used * np.log2(used)).sum()) if len(used) > 1 else 0.0
        rows = []
        for shift, slack in ((4, 0.05), (8, 0.02), (12, 0.01)):
            f, bits = k.limited_counts(n, shift)
            rows.append((pdf.ctx.iloc[0], shift, len(used), sum(f), round(least, 2), least - 1e-6 <= bits <= least * (1 + slack) + 1))
        return pd.DataFrame(rows, columns=["ctx", "shift", "symbols", "total", "least", "near"])

    h = planes.letters(spark, sf).groupBy((F.col("stream") % 16).alias("ctx"), F.expr("value div 16").alias("sym")).agg(F.count("*").alias("n"))
    return h.groupBy("ctx").applyInPandas(run, "ctx long, shift int, symbols long, total long, least double, near boolean")


_DIGEST = "count(*) AS n, CAST(sum(value * (seq + 1)) AS BIGINT) AS checksum FROM letters GROUP BY stream"


def _texts(spark, sf, run, schema: str):
    """run(bytes) for each turn's whole text, a tuple that goes behind its stream; texts are not taken apart before."""
    names = [part.split()[0] for part in schema.split(", ")]

    def each(batches):
        for b in batches:
            found = [run(raw) for raw in b["raw"].to_pylist()]
            columns = zip(*found, strict=True) if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b["stream"], *[pa.array(c, pa.float64() if "double" in part else pa.int64()) for c, part in zip(map(list, columns), schema.split(", "), strict=True)]], ["stream", *names])

    return planes.turns(spark, sf).mapInArrow(each, f"stream long, {schema}")


def _streams(spark, sf, run):
    """Per stream what a coder and its inverse give back; a stream is one turn's whole text."""

    def digest(raw: bytes) -> tuple:
        back = np.array(run(list(raw)), np.int64)
        return len(back), int((back * np.arange(1, len(back) + 1)).sum())

    return _texts(spark, sf, digest, "n long, checksum long").groupBy("stream").agg(F.sum("n").alias("n"), F.sum("checksum").alias("checksum"))


@query("ent05_rans_round_trip", f"WITH {LETTERS} SELECT stream, {_DIGEST}")
def _(spark, sf):
    def run(values: list[int]) -> list[int]:
        f = k.ans_counts(np.bincount(values, minlength=256).tolist())
        return k.rans_decode(*k.rans_encode(values, f), len(values), f)

    return _streams(spark, sf, run)


@query("ent14_lz_round_trip", f"WITH {LETTERS} SELECT stream, {_DIGEST}")
def _(spark, sf):
    return _streams(spark, sf, lambda v: k.lz_expand(k.lz_parse(v)))


@query("ent15_priced_parse")
def _(spark, sf):
    def run(raw: bytes) -> tuple:
        price = {v: float(np.log2(len(raw) / c)) + 0.5 for v, c in Counter(raw).items()}
        literal = sum(price[v] for v in raw)
        return round(literal, 3), round(k.priced_parse(raw, price), 3)

    return _texts(spark, sf, run, "literal_bits double, parsed_bits double")


@query("ent08_histogram_clusters")
def _(spark, sf):
    """Sixteen contexts' histograms are a bounded group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((16, 256))
        counts[pdf.ctx, pdf["sym"]] = pdf.n
        return pd.DataFrame({"ctx": np.arange(16), "cluster": k.cluster_histograms(counts, 8)})

    return _histograms(spark, sf).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "ctx long, cluster long")


_MASK = f"{RGB}, ink AS (SELECT img, y * 32 + x AS p, x, y FROM rgb WHERE r > 215)"


@query("seg04_components", f"""WITH RECURSIVE {_MASK}, walk AS (SELECT img, p, x, y, p AS root FROM ink UNION SELECT b.img, b.p, b.x, b.y, a.root FROM walk a JOIN ink b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
l AS (SELECT img, p, min(root) AS root FROM walk GROUP BY img, p) SELECT img, root, count(*) AS pixels FROM l GROUP BY img, root""")
def _(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root, n = np.unique(k.components8(mask_of(pdf)), return_counts=True)
        return pd.DataFrame({"img": pdf.img.iloc[0], "root": root, "pixels": n})[lambda t: t.root >= 0]

    ink = planes.rgb8(spark, sf).filter("r > 215").select("img", "x", "y")
    return ink.groupBy("img").applyInPandas(run, "img long, root long, pixels long")


@query("seg08_empty_rectangles")
def _(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w, h = k.largest_rectangle(plane_of(pdf, "r", 255) < 200)
        return pd.DataFrame({"img": [pdf.img.iloc[0]], "x": [x], "y": [y], "w": [w], "h": [h]})

    return planes.rgb8(spark, sf).groupBy("img").applyInPandas(run, "img long, x long, y long, w long, h long")


@query("seg12_simplified_lines")
def _(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("t")[["t", "v"]].to_numpy(float)
        return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]], "points": [len(p)], "kept": [len(k.simplify(p, 5000.0))]})

    return planes.signal(spark, sf).groupBy("user_id").applyInPandas(run, "user_id long, points long, kept long")


@query("ord04_improved_paths", f"""WITH {LONG}, h AS (SELECT DISTINCT img, v FROM ch WHERE c = 0) SELECT img, count(*) AS levels, CAST(max(v) - min(v) AS DOUBLE) AS cost FROM h GROUP BY img""")
def _(spark, sf):
    """An order of all of an image's levels by turning stretches round; along a line the shortest path is known."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("key").v.to_numpy(float)  # scattered, so that there is something to improve
        cost, _ = k.improved_path(np.abs(v[:, None] - v[None, :]))
        return pd.DataFrame({"img": [pdf.img.iloc[0]], "levels": [len(v)], "cost": [cost]})

    h = raw_channels(spark, sf).filter("c = 0").select("img", "v").distinct().withColumn("key", F.expr("(v * 37) % 101"))
    return h.groupBy("img").applyInPandas(run, "img long, levels long, cost double")


@query("ord04_shortest_paths")
def _(spark, sf):
    """The exact cheapest order of an image's eight most frequent levels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = pdf.sort_values(["n", "v"], ascending=[False, True]).v.head(8).to_numpy(float)
        cost, path = k.shortest_path(np.abs(top[:, None] - top[None, :]))
        return pd.DataFrame({"img": [pdf.img.iloc[0]], "cost": [cost], "first": [int(top[path[0]])], "spread": [float(top.max() - top.min())]})

    h = raw_channels(spark, sf).filter("c = 0").groupBy("img", "v").agg(F.count("*").alias("n"))
    return h.groupBy("img").applyInPandas(run, "img long, cost double, first long, spread double")


@query("trf10_best_levels")
def _(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("v")
        error, levels = k.best_levels(p.v.to_numpy(float), p.n.to_numpy(float), 4)
        return pd.DataFrame({"img": [pdf.img.iloc[0]], "error": [round(error, 4)], "levels": [[round(x, 4) for x in levels]]})

    h = raw_channels(spark, sf).filter("c = 0").groupBy("img", "v").agg(F.count("*").alias("n"))
    return h.groupBy("img").applyInPandas(run, "img long, error double, levels array<double>")


@query("opt06_coefficient_trellis")
def _(spark, sf):
    def run(batches):
        for pdf in batches:
            q = [k.trellis(np.asarray(v, float) * 8, 0.1) for v in pdf["embedding"]]
            yield pd.DataFrame({"block": pdf["vec_id"], "nonzero": [sum(x != 0 for x in r) for r in q], "size": [sum(map(abs, r)) for r in q]})

    return planes.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "block long, nonzero long, size long")


def tree_inputs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Properties of each sample's neighbourhood, and the symbols that four predictors leave, of a plane's samples in raster order."""
    at = np.arange(len(v))
    w, n = np.concatenate(([0], v[:-1])), np.concatenate((np.zeros(WIDTH, np.int64), v[:-WIDTH]))[: len(v)]
    nw = np.concatenate((np.zeros(WIDTH + 1, np.int64), v[: -WIDTH - 1]))[: len(v)]
    gradient = np.clip(w + n - nw, np.minimum(w, n), np.maximum(w, n))
    symbols = np.stack([np.minimum(np.abs(v - g), 63) for g in (w, n, (w + n) // 2, gradient)], axis=1)
    return np.stack((w, n, np.abs(w - n), np.abs(w - nw), at % WIDTH, at // WIDTH), axis=1), symbols


def by_planes(spark, sf, run, schema: str):
    """run(properties, symbols) for each plane of each image, a tuple that goes behind img and c."""

    def each(px: pa.Table, starts: np.ndarray) -> dict:
        ends = [*starts[1:].tolist(), px.num_rows]
        found = [run(*tree_inputs(v[a:e])) for v in (column(px, c) for c in "rgb") for a, e in zip(starts.tolist(), ends, strict=True)]
        names = [part.split()[0] for part in schema.split(", ")]
        key = pa.chunked_array([px["img"].combine_chunks().take(pa.array(starts))] * 3)
        return {"img": key, "c": np.repeat(np.arange(3, dtype=np.int32), len(starts)), **dict(zip(names, map(list, zip(*found, strict=True)), strict=True))}

    return by_groups(planes.rgb8(spark, sf).select("img", "i", "r", "g", "b"), ["img"], "i", each, f"img long, c int, {schema}")


@query("opt01_learned_trees")
def _(spark, sf):
    """A tree of sixteen leaves at most for each plane: every leaf has its best predictor, and splits must pay for themselves."""

    def run(x: np.ndarray, symbol: np.ndarray) -> tuple:
        leaves = k.tree_leaves(k.grow_tree(x, symbol, 16, price=20.0))
        return len(leaves), round(sum(t[2] for t in leaves), 3)

    return by_planes(spark, sf, run, "leaves long, bits double")


_SPLIT = "CASE WHEN count(*) = 1 THEN 0.0 ELSE sum(n) * log2(sum(n)) - sum(n * log2(n)) END"


@query("opt02_context_splits", f"""WITH {LONG}, s AS (SELECT img, abs(v - w) AS e, abs(w - coalesce(lag(w) OVER (PARTITION BY img ORDER BY i), 0)) AS p FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY img ORDER BY i), 0) AS w FROM ch WHERE c = 0)),
t AS (SELECT img, th, p > th AS side, e, count(*) AS n FROM s, (VALUES (4), (9), (19), (39), (79), (119)) AS x(th) GROUP BY ALL), b AS (SELECT img, th, side, {_SPLIT} AS bits, sum(n) AS m FROM t GROUP BY img, th, side),
f AS (SELECT img, {_SPLIT} AS flat FROM (SELECT img, e, count(*) AS n FROM s GROUP BY ALL) GROUP BY img), g AS (SELECT img, th, round(flat - sum(bits), 4) AS gain FROM b JOIN f USING (img) GROUP BY img, th, flat HAVING count(*) = 2 AND min(m) >= 16)
SELECT img, th AS threshold, gain, gain > 40 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY gain DESC, th) AS r FROM g) WHERE r = 1""")
def _(spark, sf):
    """The split of a context by its neighbours' activity that saves most; it stays where it saves more than it costs to tell."""
    by = W.partitionBy("img").orderBy("i")
    w = raw_channels(spark, sf).filter("c = 0").select("img", "i", "v", F.coalesce(F.lag("v").over(by), F.lit(0)).alias("w"))
    s = w.select("img", F.abs(F.col("v") - F.col("w")).alias("e"), F.abs(F.col("w") - F.coalesce(F.lag("w").over(by), F.lit(0))).alias("p"))
    cuts = (4, 9, 19, 39, 79, 119)
    h = s.groupBy("img", "e").agg(*[F.count_if(F.col("p") > t).alias(f"a{t}") for t in cuts], *[F.count_if(F.col("p") <= t).alias(f"b{t}") for t in cuts])

    def bits(n):
        used = F.when(n > 0, n)
        return F.when(F.count(used) <= 1, 0.0).otherwise(F.sum(used) * F.log2(F.sum(used)) - F.sum(used * F.log2(used)))

    col = F.col
    sums = h.groupBy("img").agg(bits(col(f"a{cuts[0]}") + col(f"b{cuts[0]}")).alias("flat"), *[(bits(col(f"a{t}")) + bits(col(f"b{t}"))).alias(f"c{t}") for t in cuts], *[F.least(F.sum(f"a{t}"), F.sum(f"b{t}")).alias(f"m{t}") for t in cuts])
    rows = F.array_compact(F.array(*[F.when(col(f"m{t}") >= 16, F.struct((-F.round(col("flat") - col(f"c{t}"), 4)).alias("g"), F.lit(t).alias("threshold"))) for t in cuts]))
    best = sums.select("img", F.array_min(rows).alias("k")).filter("k is not null")
    return best.select("img", "k.threshold", (-col("k.g")).alias("gain"), (-col("k.g") > 40).alias("kept"))


@query("opt10_strength_curve")
def _(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        curve = k.fit_strength(pdf.m.to_numpy() / 255, pdf.s.to_numpy())
        return pd.DataFrame({"img": pdf.img.iloc[0], "point": np.arange(len(curve)), "strength": np.round(curve, 6)})

    site = raw_channels(spark, sf).filter("c = 1").groupBy("img", F.expr("x div 4"), F.expr("y div 4")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return site.select("img", "m", "s").groupBy("img").applyInPandas(run, "img long, point long, strength double")


@query("ord09_shelf_packing")
def _(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("p_partkey")
        at = k.shelves([(s % 17 + 3, s % 11 + 2) for s in p.p_size.tolist()], 64)
        return pd.DataFrame({"p_partkey": p.p_partkey, "x": [a for a, _ in at], "y": [b for _, b in at]})

    parts = planes.table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 20).alias("atlas"))
    return parts.groupBy("atlas").applyInPandas(run, "p_partkey long, x long, y long")


@query("snk12_fractions", "SELECT event_id, value, true AS near, true AS held FROM events WHERE value IS NOT NULL")
def _(spark, sf):
    """Values as fractions of 32 bits: near, and within what the format's signed and unsigned halves hold."""

    def run(batches):
        for pdf in batches:
            f = [k.fraction(float(v)) for v in pdf["value"]]
            a, b = (np.array([x[i] for x in f], np.float64) for i in (0, 1))
            yield pd.DataFrame({"event_id": pdf["event_id"], "value": pdf["value"], "near": np.abs(a / b - pdf["value"]) <= 1e-6 * np.maximum(1, np.abs(pdf["value"])), "held": (np.abs(a) < 2**31) & (b >= 1) & (b < 2**32)})

    return planes.table(spark, sf, "events").filter("value is not null").select("event_id", "value").mapInPandas(run, "event_id long, value double, near boolean, held boolean")


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The samples of a batch's vectors one after another, and which vector each is of."""
    sizes = pdf["embedding"].map(len).to_numpy()
    return np.concatenate([np.asarray(v, np.float32) for v in pdf["embedding"]]) if len(pdf) else np.zeros(0, np.float32), np.repeat(np.arange(len(pdf)), sizes)


# The parts of a float as SQL can tell them: sign, exponent, and what is left above the leading one.
_PARTS = """p AS (SELECT vec_id, CAST(v AS DOUBLE) AS v, abs(CAST(v AS DOUBLE)) AS a FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings)),
e0 AS (SELECT *, CASE WHEN a > 0 THEN CAST(floor(log2(a)) AS INTEGER) END AS e0 FROM p), e AS (SELECT *, e0 + CASE WHEN a >= pow(2.0, e0 + 1) THEN 1 WHEN a < pow(2.0, e0) THEN -1 ELSE 0 END AS e FROM e0)"""


@query("prj24_half_floats", f"""WITH {_PARTS}, b AS (SELECT vec_id, CASE WHEN v < 0 THEN 32768 ELSE 0 END + CASE WHEN a = 0 THEN 0 WHEN e < -14 THEN round_even(a * pow(2.0, 24), 0) ELSE (e + 15) * 1024 + round_even((a / pow(2.0, e) - 1) * 1024, 0) END AS bits FROM e)
SELECT vec_id, CAST(sum(bits) AS BIGINT) AS bits, CAST(max(bits) AS BIGINT) AS most FROM b GROUP BY vec_id""")
def _(spark, sf):
    """Samples rounded to half floats, as the integers of their bits."""

    def run(batches):
        for pdf in batches:
            v, of = _flat(pdf)
            bits = v.astype(np.float16).view(np.uint16).astype(np.int64)
            most = np.zeros(len(pdf), np.int64)
            np.maximum.at(most, of, bits)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "bits": np.bincount(of, bits, len(pdf)).astype(np.int64), "most": most})

    return planes.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, bits long, most long")


@query("src05_float_bits", f"""WITH {_PARTS}, b AS (SELECT vec_id, CASE WHEN v < 0 THEN -2147483648 ELSE 0 END + CASE WHEN a = 0 THEN 0 ELSE (e + 127) * 8388608 + (a / pow(2.0, e) - 1) * 8388608 END AS bits FROM e)
SELECT vec_id, count(*) AS n, CAST(sum(bits) AS BIGINT) AS bits FROM b GROUP BY vec_id""")
def _(spark, sf):
    """A scan of floats as the signed integers of their bits, which lose nothing."""

    def run(batches):
        for pdf in batches:
            v, of = _flat(pdf)
            total = np.zeros(len(pdf), np.int64)
            np.add.at(total, of, v.view(np.int32).astype(np.int64))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "n": np.bincount(of, minlength=len(pdf)), "bits": total})

    return planes.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, n long, bits long")


@query("win21_invisible_fill")
def _(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, a = plane_of(pdf, "r"), plane_of(pdf, "a", 255)
        out = k.fill_invisible(v, a > 0)
        return pd.DataFrame({"img": [pdf.img.iloc[0]], "filled": [int((a == 0).sum())], "changed": [int((out != v).sum())], "total": [int(out.sum())]})

    return planes.rgb8(spark, sf).select("img", "i", "r", "a").groupBy("img").applyInPandas(run, "img long, filled long, changed long, total long")


@query("win26_closed_loop", f"""WITH {SIGNAL}, h AS (SELECT user_id, t, v, (v + 100) // 201 AS q FROM sig), d AS (SELECT *, q - coalesce(lag(q) OVER (PARTITION BY user_id ORDER BY t), 0) AS code FROM h)
SELECT user_id, count(*) AS n, CAST(sum(abs(code)) AS BIGINT) AS size, CAST(sum(abs(v - 201 * q)) AS BIGINT) AS strayed, max(abs(v - 201 * q)) AS most FROM d GROUP BY user_id""")
def _(spark, sf):
    """Residuals quantised against what a decoder will have: no sample strays by more than half a step, whatever came before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("t").v.to_numpy()
        codes, have = k.closed_loop(v, 201)
        return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]], "n": [len(v)], "size": [int(np.abs(codes).sum())], "strayed": [int(np.abs(v - have).sum())], "most": [int(np.abs(v - have).max())]})

    return planes.signal(spark, sf).groupBy("user_id").applyInPandas(run, "user_id long, n long, size long, strayed long, most long")
