"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown level by level on binned statistics and kept as complete heaps in flat arrays, so a batch
of documents walks every tree with a few numpy steps a level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicq.llm.common import table, texts

#: Labelled documents that a fit takes at most, picked by hash: the one bounded sample here.
SAMPLE = 40_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 10

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_PLAIN_MARKS = np.isin(np.arange(256), list(b".,;:'\"()-?"))
_ASCII_MARKS = (np.arange(256) > 32) & (np.arange(256) < 127) & ~_LOWER & ~_UPPER & ~_DIGIT & ~_PLAIN_MARKS


def statistics(text: str) -> list[float]:
    """Numbers about one text; all are zero or finite, for empty text too."""
    raw = text.encode()
    n = max(1, len(raw))
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lower = [w.lower() for w in words]
    distinct, m = set(lower), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x]
    pairs = set(zip(lower, lower[1:], strict=False))
    letters = max(1, int(by_byte[_LOWER].sum() + by_byte[_UPPER].sum() + by_byte[_HIGH].sum()))
    share = by_byte[by_byte > 0] / n
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        by_byte[_UPPER].sum() / letters,
        by_byte[_DIGIT].sum() / n,
        by_byte[_PLAIN_MARKS].sum() / n,
        by_byte[_ASCII_MARKS].sum() / n,
        by_byte[_HIGH].sum() / n,
        by_byte[ord("|")] / m,
        by_byte[ord("!")] / m,
        by_byte[ord(".")] / m,
        by_byte[ord(",")] / m,
        float(-(share * np.log2(share)).sum()),
        len(distinct) / m,
        len(distinct) / m**0.8,
        len(pairs) / m,
        np.log1p(len(lines)),
        len(words) / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(1, len(lines)),
        sum(w[:1].isupper() for w in words) / m,
        sum(w.isalpha() for w in words) / m,
    ]


N_STATISTICS = len(statistics(""))


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, N_STATISTICS)


class Trees:
    """Boosted trees for a 0/1 target under logistic loss."""

    def __init__(self, base: float):
        self.base = base
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int32)
        self.threshold = np.zeros((0, 2**DEPTH - 1))
        self.leaf = np.zeros((0, 2**DEPTH))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
        """No rows: every score is one half. Rows of one label: that label's smoothed share."""
        mean = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(float(np.log(mean / (1 - mean))))
        if not len(y) or y.min() == y.max():
            return model
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.int64)
        raw, grown = np.full(len(y), model.base), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = cls._grow(binned, cuts, p - y, p * (1 - p))
            raw += tree[2][leaf]
            grown.append(tree)
        model.feature, model.threshold, model.leaf = (np.stack(a) for a in zip(*grown, strict=True))
        return model

    @staticmethod
    def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple:
        feature, threshold = np.zeros(2**DEPTH - 1, np.int32), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(g), np.int64)  # within its level
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            chosen = np.full(width, BINS, np.int64)
            for f in range(binned.shape[1]):
                key = node * BINS + binned[:, f]
                sums = [np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                gain[:, len(cuts[f]) :] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], chosen[better] = top[better], at[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = cuts[f][at[better]]
            node = 2 * node + (binned[np.arange(len(g)), feature[first + node]] > chosen[node])
        leaf = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + L2)
        return (feature, threshold, leaf), node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: every tree is walked for all rows at once."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-raw))


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns labels.quality from at most `sample` labelled documents outside the held-out third.

    Labels without a doc_id or quality don't count; several labels of one document count as their mean, rounded.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("doc_id is not null and quality is not null")
    own = own.groupBy("doc_id").agg(F.round(F.avg("quality")).alias("quality")).filter(remainder(3) != 1)
    picked = own.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_STATISTICS).cast(pa.list_(pa.float64())), b["quality"], b["doc_id"]], ["x", "quality", "doc_id"])

    rows = texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality").mapInArrow(measure, "x array<double>, quality double, doc_id long")
    got = rows.orderBy("doc_id", "x").limit(sample).toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, N_STATISTICS))
    return Trees.fit(x, got["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; null text scores as empty, a null doc_id isn't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(matrix(b["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """docs without the rows that the model rejects, all columns kept; each row is judged by its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(matrix(b["text"].to_pylist())) >= least))

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
