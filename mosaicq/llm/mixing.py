"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every source shuffles its documents by a seeded hash and serves them up to MAX_EPOCHS times over. A copy's virtual finish
time is the source's tokens served by then, the copy's own to its middle, divided by the source's weight. The mix is the
global order of those times, truncated where it has spent the total budget, all sources' tokens: of the copy across the end
half must fit. Counting a copy to its middle keeps each source within half a document of its target, not a whole one below.

No task holds a source or the mix: sums before a copy come from buckets of the shuffle hash, and the end of the budget from
ranges of virtual time, both added up in two steps; only the range in which the budget ends is put in order row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.llm.common import cut, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one bucket of the shuffle hash, or one range of virtual time, is planned to hold; a source of any size is cut into such.
BUCKET_ROWS = 512
#: Ranges of virtual time that are added up together.
RANGES = 4096
_BEFORE = (W.unboundedPreceding, -1)


def _columns(seed: int) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("m_source"),  # the order of code points, null last
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("m_size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)).alias("m_hash"),
        F.col("doc_id").alias("m_doc"),
    ]


def targets(lean: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(m_source, source_size, weight, target), one row a source: shares by weight, none above epochs * size."""
    sizes = lean.groupBy("m_source").agg(F.sum("m_size").alias("source_size"))
    rank = F.row_number().over(W.orderBy("m_source")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio, whole = W.orderBy("ratio", "m_source").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    src = src.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
    src = src.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    src = src.withColumn("time", (F.sum("source_size").over(whole) - F.col("full")) / F.col("open"))
    # with the sources of smaller ratio full, the first whose own ratio is not reached stops the clock
    reached = F.when(F.col("time") <= F.col("ratio"), F.struct("ratio", "m_source"))
    stop = F.min_by("time", reached).over(whole)
    return src.select("m_source", "source_size", "weight", F.coalesce(F.least("cap", F.col("weight") * stop), F.lit(0.0)).alias("target"))


def _prefix(sums: DataFrame, by: list[str], hi: str, lo: str) -> DataFrame:
    """sums with m_base, the m_sum of all rows before in the order of hi and lo; first within each hi, then over the his."""
    outer = sums.groupBy(*by, hi).agg(F.sum("m_sum").alias("m_outer"))
    outer = outer.withColumn("m_outer", F.coalesce(F.sum("m_outer").over(W.partitionBy(*by).orderBy(hi).rowsBetween(*_BEFORE)), F.lit(0)))
    inner = F.coalesce(F.sum("m_sum").over(W.partitionBy(*by, hi).orderBy(lo).rowsBetween(*_BEFORE)), F.lit(0))
    return sums.withColumn("m_inner", inner).join(outer, [*by, hi]).withColumn("m_base", F.col("m_outer") + F.col("m_inner")).drop("m_outer", "m_inner")


def _placed(rows: DataFrame, lean: DataFrame, n: int, plan: DataFrame) -> DataFrame:
    """rows with plan's columns and the tokens of their source that one epoch serves before them (m_start)."""
    digits = max(2, -(-(n // BUCKET_ROWS).bit_length() // 4))
    hi, lo = F.substring("m_hash", 1, digits // 2), F.substring("m_hash", digits // 2 + 1, digits - digits // 2)
    at = ["m_source", "m_hi", "m_lo"]
    base = _prefix(lean.groupBy("m_source", hi.alias("m_hi"), lo.alias("m_lo")).agg(F.sum("m_size").alias("m_sum")), ["m_source"], "m_hi", "m_lo")
    rows = rows.withColumns({"m_hi": hi, "m_lo": lo}).join(base.join(plan, "m_source"), at)
    inside = W.partitionBy(*at).orderBy("m_hash", "m_doc", "m_size").rowsBetween(*_BEFORE)
    return rows.withColumn("m_start", F.col("m_base") + F.coalesce(F.sum("m_size").over(inside), F.lit(0)))


def _times(epochs: int) -> Column:
    """The virtual finish time of each copy."""
    return F.array(*[(F.lit(e).cast("long") * F.col("source_size") + F.col("m_start") + F.col("m_size") / F.lit(2.0)) / F.col("weight") for e in range(epochs)])


def _key(time: Column) -> Column:
    """The mix's order: by time, then source, hash and place in the source."""
    return F.struct(time.alias("t"), F.col("m_source").alias("s"), F.col("m_hash").alias("h"), F.col("m_start").alias("p"))


def _taken(placed: DataFrame, n: int, plan: DataFrame, epochs: int):
    """A condition on a copy's virtual finish time: the copy stands before the budget's end. One row reaches the driver."""
    total, weights = plan.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return lambda time: F.lit(False)
    width = total / weights / (n // BUCKET_ROWS + 1)  # a range holds the budget's like share of tokens at most, and a document
    span = lambda time: F.floor(time / F.lit(width))
    copies = placed.filter("m_size > 0").select("m_source", "m_hash", "m_start", "m_size", F.explode(_times(epochs)).alias("m_time")).withColumn("m_range", span(F.col("m_time")))
    sums = copies.groupBy("m_range").agg(F.sum("m_size").alias("m_sum")).withColumn("m_hi", F.floor(F.col("m_range") / RANGES))
    end = _prefix(sums, [], "m_hi", "m_range").filter(f"m_base <= {total} and m_base + m_sum > {total}").select("m_range", "m_base").first()
    if end is None:
        return lambda time: F.lit(True)
    last = copies.filter(F.col("m_range") == end.m_range).withColumn("k", _key(F.col("m_time")))
    before = F.coalesce(F.sum("m_size").over(W.partitionBy("m_range").orderBy("k").rowsBetween(*_BEFORE)), F.lit(0))
    fits = last.withColumn("m_before", before + end.m_base).filter(F.col("m_before") + F.col("m_size") / F.lit(2.0) <= F.lit(total)).agg(F.max("k").alias("k")).first().k
    if fits is None:
        return lambda time: span(time) < end.m_range
    limit = F.struct(F.lit(fits.t).alias("t"), F.lit(fits.s).alias("s"), F.lit(fits.h).alias("h"), F.lit(fits.p).alias("p"))
    return lambda time: _key(time) <= limit


def _mixed(docs: DataFrame, weights: tuple[float, ...], epochs: int, seed: int) -> tuple[DataFrame, int, DataFrame, Column]:
    """Lean rows of all documents, their number, the plan by source and the virtual finish times of the copies taken."""
    lean = cut(docs.select(*_columns(seed)))
    n, plan = lean.count(), cut(targets(lean, weights, epochs))
    placed = cut(_placed(lean, lean, n, plan))
    taken = _taken(placed, n, plan, epochs)
    return placed, n, plan, F.when(F.col("m_size") > 0, F.filter(_times(epochs), taken)).otherwise(F.array().cast("array<double>"))


def shares(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document; taken counts repeats.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, the last. Null or repeated doc_id:
    rows of their own. The order of the shuffle depends on seed, doc_id and text alone, so reruns agree.
    No documents: no rows.
    """
    placed, _, _, times = _mixed(docs, weights, epochs, seed)
    return placed.select(F.col("m_doc").alias("doc_id"), F.col("m_size").alias("size"), "source_size", "target", (F.col("m_size") * F.size(times)).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The mix itself: documents' own columns, a row for each copy taken, range-sorted by virtual finish time."""
    lean, n, plan, times = _mixed(docs, weights, epochs, seed)
    payload = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row"), *_columns(seed))
    copies = _placed(payload, lean, n, plan).withColumn("m_time", F.explode(times))
    return copies.orderBy("m_time", "m_source", "m_hash", "m_start").select("m_row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k) - 1 AS rank FROM d GROUP BY k),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
t AS (SELECT *, coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE) AS open_weight, sum(source_size) OVER ()::DOUBLE AS total
  FROM r WINDOW b AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - filled) / open_weight AS clock FROM t),
stop AS (SELECT clock AS at_time FROM c WHERE clock <= ratio ORDER BY ratio, k LIMIT 1),
g AS (SELECT k, source_size, coalesce(least(cap, weight * at_time), 0.0::DOUBLE) AS target FROM c LEFT JOIN stop ON true),
p AS (SELECT d.*, row_number() OVER () AS r, source_size, target, w.weight, coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS served
  FROM d JOIN g USING (k) JOIN (SELECT k, weight FROM w) w USING (k)),
e AS (SELECT p.*, (epoch * source_size + served + size / 2.0::DOUBLE) / weight AS finish FROM p, range(3) AS x(epoch) WHERE size > 0),
o AS (SELECT r, size, coalesce(sum(size) OVER (ORDER BY finish, k, h, served ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
m AS (SELECT r, count(*) AS copies FROM o WHERE before + size / 2.0::DOUBLE <= (SELECT sum(size) FROM d) GROUP BY r)
SELECT doc_id, size, source_size, target, size * coalesce(copies, 0) AS taken FROM p LEFT JOIN m USING (r)
"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"))
