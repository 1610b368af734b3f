"""Histograms and what they cost to code, in bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(tokens: DataFrame, *keys: str, symbol: str = "token") -> DataFrame:
    """(keys, symbol, n)."""
    return tokens.groupBy(*keys, symbol).agg(F.count("*").alias("n"))


def shannon(n: str | Column = "n") -> Column:
    """Aggregate: order-0 bits of the counts n; nothing for one symbol, one bit each for two."""
    n = F.col(n) if isinstance(n, str) else n
    total = F.sum(n)
    return F.when(F.count(n) <= 1, F.lit(0.0)).when(F.count(n) == 2, total.cast("double")).otherwise(total * F.log2(total) - F.sum(n * F.log2(n)))


def entropy(n: str | Column = "n") -> Column:
    """Aggregate: the same without the rule for two symbols."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(F.count(n) <= 1, F.lit(0.0)).otherwise(F.sum(n) * F.log2(F.sum(n)) - F.sum(n * F.log2(n)))


def token_cost(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, samples, raw_bits, bits): Shannon bits of the tokens by key, and the bits that go out as they are."""
    by = tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"), F.sum("nbits").alias("raw"))
    return by.groupBy(*keys).agg(F.sum("n").alias("samples"), F.sum("raw").alias("raw_bits"), shannon().alias("bits"))
