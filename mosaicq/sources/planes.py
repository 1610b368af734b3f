"""Image views over the driver tables, and scans of interleaved sample buffers.

An image is a supplier's line items in key order, WIDTH to a row; its three channels are quantity, discount and
tax as integers. Every image is laid out by itself, so the order is a window per image and never a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 32
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
#: Bytes of a table's files that make one partition where rows are dealt.
PART_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, of: DataFrame, *keys: str, size: int | None = None) -> DataFrame:
    """df dealt by keys to a partition for each `size` bytes (PART_BYTES) of the files of the table `of`, so that what a task holds doesn't grow with
    the input; a partition a core at least. Operators that ask for these keys, or for more, find them in place."""
    files = int(str(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-files // (size or PART_BYTES))), *keys)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, i, x, y, c0, c1, c2, a): one row a pixel in raster order i; a is 0 where c2 is, else 255. Images are whole in their partitions."""
    whole = table(spark, sf_dir, "lineitem")
    item = dealt(whole.select("l_suppkey", *ORDER, "l_quantity", "l_discount", "l_tax"), whole, "l_suppkey")
    i = (F.row_number().over(W.partitionBy("l_suppkey").orderBy(*ORDER)) - 1).cast("long")
    px = item.select(F.col("l_suppkey").alias("img"), i.alias("i"), F.col("l_quantity").cast("long").alias("c0"), F.round(F.col("l_discount") * 100).cast("long").alias("c1"), F.round(F.col("l_tax") * 100).cast("long").alias("c2"))
    return px.select("img", "i", (F.col("i") % WIDTH).alias("x"), F.expr(f"i div {WIDTH}").alias("y"), "c0", "c1", "c2", F.when(F.col("c2") == 0, 0).otherwise(255).cast("long").alias("a"))


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels with the channels spread over eight bits: r, g, b."""
    return pixels(spark, sf_dir).select("img", "i", "x", "y", (F.col("c0") * 5).alias("r"), (F.col("c1") * 25).alias("g"), (F.col("c2") * 31).alias("b"), "a")


def channels(px: DataFrame, *names: str) -> DataFrame:
    """(img, c, i, x, y, v): a row for each sample of the named columns, c counting from 0."""
    pairs = ", ".join(f"{k}, {n}" for k, n in enumerate(names))
    return px.select("img", "i", "x", "y", F.expr(f"stack({len(names)}, {pairs}) AS (c, v)")).select("img", "c", "i", "x", "y", "v")


def buffers(px: DataFrame, *names: str) -> DataFrame:
    """(img, width, samples): each image's pixels interleaved in one array."""
    pixel = F.struct("i", F.array(*[F.col(n) for n in names]).alias("s"))
    return px.groupBy("img").agg(F.sort_array(F.collect_list(pixel)).alias("p")).select("img", F.lit(WIDTH).alias("width"), F.flatten(F.col("p.s")).alias("samples"))


def scan_interleaved(buf: DataFrame, n: int, bits: int = 8) -> DataFrame:
    """(img, c, i, x, y, v) of interleaved buffers of n channels, samples held to what `bits` can say.

    A buffer whose length is no multiple of n, or whose width is not positive, is an error.
    """
    whole = F.assert_true((F.size("samples") % n == 0) & (F.col("width") > 0), F.lit("a buffer's length doesn't match its channels"))
    rows = buf.filter(whole.isNull()).select("img", "width", F.posexplode("samples").alias("pos", "raw"))
    i = F.expr(f"pos div {n}").cast("long")
    return rows.select("img", (F.col("pos") % n).alias("c"), i.alias("i"), (i % F.col("width")).alias("x"), F.expr(f"(pos div {n}) div width").alias("y"), F.least("raw", F.lit((1 << bits) - 1)).cast("long").alias("v"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, t, v): each user's events in time order as hundredths."""
    whole = table(spark, sf_dir, "events")
    ev = dealt(whole.filter("value is not null").select("user_id", "ts", "event_id", "value"), whole, "user_id")
    t = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return ev.select("user_id", t.cast("long").alias("t"), F.round(F.col("value") * 100).cast("long").alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, k, v): every embedding as an 8x8 block of samples, k in raster order."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block"), F.posexplode("embedding").alias("k", "v")).select("block", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, d, image, bpp, m1, m2): rate and quality samples; m2 is missing where m1 is zero."""
    item = table(spark, sf_dir, "lineitem")
    m1 = F.round(F.col("l_discount") * 100)
    return item.select(F.concat("l_returnflag", "l_linestatus").alias("series"), F.col("l_tax").alias("d"), F.col("l_suppkey").alias("image"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("bpp"), m1.alias("m1"), F.when(m1 > 0, F.col("l_quantity")).alias("m2"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, raw): each conversation turn's whole text as UTF-8 bytes, streams whole in their partitions; empty ones and nulls have none."""
    whole = table(spark, sf_dir, "conversations")
    said = whole.filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream"), F.encode("text", "UTF-8").alias("raw"))
    return dealt(said.filter(F.octet_length("raw") > 0), whole, "stream", size=PART_BYTES >> 2)


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, seq, value): the bytes of turns, one stream a turn."""
    at = F.explode(F.sequence(F.lit(1), F.octet_length("raw"))).alias("at")
    rows = turns(spark, sf_dir).select("stream", "raw", at)
    byte = F.conv(F.hex(F.substring("raw", F.col("at"), F.lit(1))), 16, 10).cast("long")
    return rows.select("stream", (F.col("at") - 1).cast("long").alias("seq"), byte.alias("value"))
