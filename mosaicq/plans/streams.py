"""Queries that run as streams and must agree with the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mosaicq.plans.catalog import query
from mosaicq.streaming import progressive


@query("str02_streamed_histogram", "SELECT event_type, CAST(floor(log2(greatest(value, 0.01))) AS BIGINT) AS level, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return progressive.drain(spark, progressive.histogram(progressive.events(spark, sf)), f"histogram_{uuid.uuid4().hex[:8]}")


@query("str03_streamed_rates", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    out = progressive.drain(spark, progressive.rates(progressive.events(spark, sf)), f"rates_{uuid.uuid4().hex[:8]}")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
