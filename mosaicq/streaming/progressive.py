"""Streams: the running histogram and windowed rates of events, as Structured Streaming."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str, files_a_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def histogram(stream: DataFrame) -> DataFrame:
    """Counts of the values' leading magnitude by type, kept as state."""
    level = F.floor(F.log2(F.greatest(F.col("value"), F.lit(0.01)))).cast("long")
    return stream.filter("value is not null").groupBy("event_type", level.alias("level")).agg(F.count("*").alias("n"))


def rates(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and totals by window of event time; state older than the watermark is dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result table, which every batch writes anew."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mosaicq-stream-")  # one machine
    out = f"{folder}/{name}-result"
    put = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
