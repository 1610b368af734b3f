"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python group or shard is planned to hold.
CHUNK_BYTES = 16 << 20


class Places(dict):
    """Gives each new key the next place."""

    def __missing__(self, key) -> int:
        self[key] = place = len(self)
        return place


def slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text."""
    if batch.num_rows:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(size, ends[-1] + 1, size), side="right"), [batch.num_rows])))
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            yield batch.slice(a, b - a)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one that the session has set; on one machine, where neither is, one of our own."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (None if own.isEmpty() else own.get())
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mosaicq-")
    if own.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in files that all executors see."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same by a compressed table in the shared folder, for what is large."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of stored(df), once all that reads them is written."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written; else they stay until the driver needs memory.

    Events that listeners have yet to take hold the plans of those steps, so the queues are emptied first, if that takes no longer than a few seconds."""
    with contextlib.suppress(Py4JJavaError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5000)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so further columns can't clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def chunk_count(total: int, size: int = CHUNK_BYTES) -> int:
    """How many chunks of about `size` bytes hold all; grows with the input, never with one key."""
    return max(4, -(-total // size))


def chunk_of(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def pack_chunks(df: DataFrame, level: int = 3) -> DataFrame:
    """(chunk, rows): df's rows, which have a chunk each, as compressed Arrow streams, one for each batch and chunk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))
        for b in batches:
            chunk = b["chunk"].to_numpy(zero_copy_only=False)
            order = np.argsort(chunk, kind="stable")
            found, first = np.unique(chunk[order], return_index=True)
            rest = b.drop_columns(["chunk"])
            for at, part in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=options) as out:
                    out.write_batch(rest.take(pa.array(part)))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    return df.mapInArrow(pack, "chunk int, rows binary")


def unpack_chunk(group: pa.Table) -> pa.Table:
    """A chunk's rows, in no certain order."""
    return pa.concat_tables([pa.ipc.open_stream(raw.as_buffer()).read_all() for raw in group["rows"]]).combine_chunks()


def by_chunk(packed: DataFrame, n: int) -> DataFrame:
    """Packed chunks, numbered below n, cut in a partition each; what groups them by chunk afterwards finds them in place.

    A checkpoint keeps its plan's partitioning unless the plan is adaptive, so this one is not."""
    conf, name = packed.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(packed.repartitionById(n, F.col("chunk")))
    finally:
        conf.set(name, before)
        release(packed.sparkSession)
