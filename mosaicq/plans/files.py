"""Queries over files of another format: JPEG segments, coefficients, and what a transcoder plans from them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mosaicq.operators import kernels as kernel
from mosaicq.plans.blocks import _Q, quantised
from mosaicq.plans.catalog import query
from mosaicq.sources import bundles, jpeg, planes

#: Blocks side by side in one file.
ACROSS = 16


def files(spark, sf):
    """(file, data): the quantised blocks of embeddings as grey JPEG files of up to ACROSS blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.sort_values(["block", "k"]).q.to_numpy().astype(np.int64).reshape(-1, 64)
        return pd.DataFrame({"file": [pdf.file.iloc[0]], "data": [jpeg.write(q, 8, 8 * len(q))]})

    q = quantised(spark, sf).select(F.expr(f"block div {ACROSS}").alias("file"), "block", "k", "q")
    return q.groupBy("file").applyInPandas(run, "file long, data binary")


def decoded(data):
    """(file, column, k, q) of every coefficient in files (file, data)."""

    def run(batches):
        for pdf in batches:
            for file, raw in zip(pdf["file"], pdf["data"], strict=True):
                for plane in jpeg.coefficients(raw).values():
                    q = plane.reshape(-1, 64)
                    yield pd.DataFrame({"file": file, "column": np.repeat(np.arange(len(q)), 64), "k": np.tile(np.arange(64), len(q)), "q": q.reshape(-1)})

    return data.mapInPandas(run, "file long, column long, k long, q long")


_ROWS = f"{_Q}, r AS (SELECT block // {ACROSS} AS file, dense_rank() OVER (PARTITION BY block // {ACROSS} ORDER BY block) - 1 AS col, k, CAST(q AS BIGINT) AS q FROM q)"


@query("src07_jpeg_coefficients", f'WITH {_ROWS} SELECT file, col AS "column", k, q FROM r')
def _(spark, sf):
    """Files of Huffman-coded blocks, parsed marker by marker and decoded to their coefficients."""
    return decoded(files(spark, sf))


@query("sup25_jpeg_plan", f"""WITH {_ROWS}, b AS (SELECT file, col, max(CASE WHEN k = 0 THEN q END) AS dc, count(*) FILTER (WHERE k > 0 AND q <> 0) AS nz FROM r GROUP BY file, col)
SELECT file, count(*) AS blocks, count(*) FILTER (WHERE nz > 0) AS coded, CAST(sum(nz) AS BIGINT) AS nonzero, min(dc) AS dc_low, max(dc) AS dc_high FROM b GROUP BY file""")
def _(spark, sf):
    """What a transcoder plans a file by: its blocks, those with more than their mean, and the means' range."""
    b = decoded(files(spark, sf)).groupBy("file", "column").agg(F.max(F.when(F.col("k") == 0, F.col("q"))).alias("dc"), F.count_if((F.col("k") > 0) & (F.col("q") != 0)).alias("nz"))
    return b.groupBy("file").agg(F.count("*").alias("blocks"), F.count_if(F.col("nz") > 0).alias("coded"), F.sum("nz").alias("nonzero"), F.min("dc").alias("dc_low"), F.max("dc").alias("dc_high"))


@query("src08_jpeg_segments", f"""SELECT page_id, 2 + CAST(ceil(octet_length(encode(html)) / {jpeg.ICC_PART}.0) AS BIGINT) AS segments, octet_length(encode(html)) AS icc_bytes, md5(html) AS icc_md5, url AS xmp, octet_length(encode(url)) AS exif_bytes FROM pages WHERE html <> '' AND url IS NOT NULL""")
def _(spark, sf):
    """Profile, camera data and XML packet, found among a file's segments and put together from their parts."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page, html, url in zip(pdf["page_id"], pdf["html"], pdf["url"], strict=True):
                data = jpeg.write(np.zeros((1, 64), np.int64), 8, 8, jpeg.application(html.encode(), url.encode(), url.encode()))
                own = jpeg.kept(data)
                n = sum(marker in (jpeg.APP1, jpeg.APP2) for marker, _ in jpeg.segments(data))
                rows.append((page, n, len(own["icc"]), hashlib.md5(own["icc"]).hexdigest(), own["xmp"].decode(), len(own["exif"])))
            yield pd.DataFrame(rows, columns=["page_id", "segments", "icc_bytes", "icc_md5", "xmp", "exif_bytes"])

    pages = planes.table(spark, sf, "pages").filter("html <> '' and url is not null").select("page_id", "html", "url")
    return pages.mapInPandas(run, "page_id long, segments long, icc_bytes long, icc_md5 string, xmp string, exif_bytes long")


@query("snk11_gain_map_bundles", """SELECT page_id, 8 + octet_length(encode(url)) + page_id % 7 + octet_length(encode(html)) AS bytes, url AS metadata, page_id % 7 AS profile_bytes, md5(html) AS image_md5 FROM pages WHERE html IS NOT NULL AND url IS NOT NULL""")
def _(spark, sf):
    """A gain map's parts, bundled and taken apart again."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page, html, url in zip(pdf["page_id"], pdf["html"], pdf["url"], strict=True):
                bundle = bundles.write(url.encode(), html.encode(), b"p" * (page % 7))
                own = bundles.read(bundle)
                rows.append((page, len(bundle), own["metadata"].decode(), len(own["profile"]), hashlib.md5(own["image"]).hexdigest()))
            yield pd.DataFrame(rows, columns=["page_id", "bytes", "metadata", "profile_bytes", "image_md5"])

    pages = planes.table(spark, sf, "pages").filter("html is not null and url is not null").select("page_id", "html", "url")
    return pages.mapInPandas(run, "page_id long, bytes long, metadata string, profile_bytes long, image_md5 string")


@query("snk09_packed_blobs")
def _(spark, sf):
    """Metadata packed by copies and three prefix codes; stored as it is where that is no smaller."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
                raw = html.encode()
                bits, tokens = kernel.packed_bits(list(raw))
                size = min(len(raw), -(-bits // 8)) + 4
                rows.append((page, len(raw), size, -(-bits // 8) < len(raw), bytes(kernel.lz_expand(tokens)) == raw))
            yield pd.DataFrame(rows, columns=["page_id", "plain", "bytes", "packed", "restored"])

    pages = planes.table(spark, sf, "pages").filter("html is not null").select("page_id", "html")
    return pages.mapInPandas(run, "page_id long, plain long, bytes long, packed boolean, restored boolean")
