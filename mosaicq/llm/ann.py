"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

A shard holds about SHARD distinct vectors. Its graph is a set of flat neighbour arrays, one for each layer,
which batches of points or queries walk together. A further component lifts all vectors to one length, so
that the largest inner product is also the nearest point and the graph is one of a metric space.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.llm.common import cut, table

#: Distinct vectors a shard holds: more would take a wider search for the same recall on vectors without near neighbours; queries that travel with a shard's graph at once, and that walk it together.
SHARD = 8192
QUERY_BLOCK, WALK = 8192, 256
K = 20
LINKS, EF_BUILD, EF_SEARCH, BATCH = 16, 100, 400, 64
#: Nodes a walk expands at once, so that its list is sorted so many times less.
WIDE = 8
#: A shard is searched with the narrowest of these that finds RECALL of what brute force finds for SAMPLE of its own vectors, else with EF_SEARCH.
NARROW, RECALL, SAMPLE = (64, 100, 200), 0.999, 128


class Graph:
    """Layers of flat neighbour arrays over unit-length rows of x; -1 fills what is free."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 11) -> Graph:
        n = len(x)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 6)
        level[0] = level.max(initial=0)  # the first point is the entry to every layer
        layers = [np.full((n, LINKS * 2 if k == 0 else LINKS), -1, np.int32) for k in range(level.max(initial=0) + 1)]
        graph = cls(x, layers, 0)
        for at in range(1, n, BATCH):
            graph._insert(np.arange(at, min(n, at + BATCH)), level)
        return graph

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        q = self.x[new]
        own = q @ q.T
        entry = np.zeros(len(new), np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            found, near = self._walk(q, entry, layer, EF_BUILD if layer == 0 or (level[new] >= layer).any() else 1)
            entry = found[:, 0]
            for i in np.flatnonzero(level[new] >= layer):
                peers = np.flatnonzero(level[new[:i]] >= layer)  # of the same batch
                c = np.concatenate((found[i][found[i] >= 0], new[peers]))
                s = np.concatenate((near[i][found[i] >= 0], own[i, peers]))
                chosen = self._spread(c, s, LINKS)
                self.layers[layer][new[i], : len(chosen)] = chosen
                for c in chosen:
                    self._link(layer, int(c), int(new[i]))

    def _link(self, layer: int, node: int, other: int) -> None:
        row = self.layers[layer][node]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = other
            return
        c = np.append(row, other)
        kept = self._spread(c, self.x[c] @ self.x[node], len(row))
        row[:] = -1
        row[: len(kept)] = kept

    def _spread(self, c: np.ndarray, s: np.ndarray, most: int) -> np.ndarray:
        """Candidates nearer to the point than to any chosen before; the nearest of the others fill up."""
        order = np.argsort(-s, kind="stable")[: 4 * most]
        c, s = c[order], s[order]
        if len(c) <= most:
            return c
        between = self.x[c] @ self.x[c].T
        hidden, chosen = np.zeros(len(c), bool), []
        for i in range(len(c)):
            if not hidden[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                hidden |= between[i] > s
        rest = np.setdiff1d(np.arange(len(c)), chosen)[: most - len(chosen)]
        return c[np.concatenate((chosen, rest)).astype(int)]

    def _walk(self, q: np.ndarray, entry: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes found for each row of q, best first, and their products; -1 where there are fewer."""
        neighbours, m = self.layers[layer], len(q)
        seen = np.zeros((m, len(self.x) + 1), bool)
        seen[:, -1] = True  # for -1
        ids = np.full((m, ef), -1, np.int64)
        near = np.full((m, ef), -np.inf, np.float32)
        done = np.ones((m, ef), bool)
        ids[:, 0], done[:, 0] = entry, False
        near[:, 0] = np.einsum("ij,ij->i", q, self.x[entry])
        seen[np.arange(m), entry] = True
        live, wide = np.arange(m), min(WIDE, ef)
        while True:
            live = live[~done[live].all(axis=1)]
            if not len(live):
                break
            place = np.cumsum(~done[live], axis=1)  # rows are sorted: the best not yet expanded, some at a time
            r, c = np.nonzero(~done[live] & (place <= wide))
            more = np.full((len(live), wide, neighbours.shape[1]), -1, np.int64)
            more[r, place[r, c] - 1] = neighbours[ids[live[r], c]]
            done[live[r], c] = True
            more = more.reshape(len(live), -1)
            more[seen[live[:, None], more]] = -1
            more.sort(axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1  # two that are expanded may share a neighbour
            r, c = np.nonzero(more >= 0)
            found = more[r, c]
            seen[live[r], found] = True
            products = np.einsum("ij,ij->i", q[live[r]], self.x[found])
            better = products > near[live[r], -1]
            r, found, products = r[better], found[better], products[better]
            n = np.bincount(r, minlength=len(live))
            at = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            new_ids = np.full((len(live), n.max(initial=0)), -1, np.int64)
            new_near = np.full(new_ids.shape, -np.inf, np.float32)
            new_ids[r, at], new_near[r, at] = found, products
            all_ids, all_near, all_done = (np.concatenate(x, axis=1) for x in ((ids[live], new_ids), (near[live], new_near), (done[live], new_ids < 0)))
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :ef]
            ids[live], near[live], done[live] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_near, all_done))
        return ids, near

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        entry = np.full(len(q), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self._walk(q, entry, layer, 1)[0][:, 0]
        return self._walk(q, entry, 0, max(ef, 1))[0]

    def width(self, x: np.ndarray, k: int) -> int:
        """How wide a search for the k nearest has to be; x: the vectors before they were lifted and scaled."""
        own = x[np.unique(np.linspace(0, len(x) - 1, SAMPLE).astype(int))]
        k = min(k, len(x))
        nearest = np.argpartition(-(own @ x.T), k - 1, axis=1)[:, :k]
        asked = np.column_stack((own, np.zeros(len(own)))).astype(np.float32)
        for ef in (w for w in NARROW if 2 * k <= w < EF_SEARCH):
            found = self.search(asked, min(ef, len(x)))
            if sum(len(np.intersect1d(a, b)) for a, b in zip(nearest, found, strict=True)) >= RECALL * nearest.size:
                return ef
        return EF_SEARCH


def _matrix(column, width: int | None = None) -> np.ndarray:
    rows = [np.asarray(v, np.float64) for v in column.to_pylist()]
    x = np.zeros((len(rows), width or max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    return x


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part: not null, no null or non-finite component, not zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.filter(F.coalesce(fine, F.lit(False))).withColumn("norm", norm).filter("norm > 0")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, the k nearest found among the others.

    score is the inner product in double precision; ties go to the smaller vec_id. Equal vectors are one node of
    the graph that keeps its k + 1 least vec_ids, so copies, however many, can't crowd a shard. Shorter vectors
    count as filled with zeros. Repeated rows count each. No vectors: no rows.
    """
    own = usable(vectors)
    by_vector = W.partitionBy("v").orderBy("vec_id")
    first = own.withColumn("m_n", F.row_number().over(by_vector)).filter(F.col("m_n") <= k + 1)
    nodes = cut(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max("norm").alias("norm")))
    n, longest, width = nodes.agg(F.count("*"), F.max("norm"), F.max(F.size("v"))).first()
    shards = max(1, -(-n // shard))
    lift, width = longest or 1.0, width or 0

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending")])
        x = _matrix(group["v"], width)
        rest = np.sqrt(np.maximum(0, lift**2 - (x**2).sum(axis=1)))
        graph = Graph.build((np.column_stack((x, rest)) / lift).astype(np.float32))
        ids = [np.asarray(v, np.int64) for v in group["ids"].to_pylist()]
        packed = _pack(x=x, rest=rest, ef=graph.width(x, k + 1), ids=np.concatenate(ids), ends=np.cumsum([len(v) for v in ids]), **{f"layer{i}": a for i, a in enumerate(graph.layers)})
        return pa.table({"shard": group["shard"].slice(0, 1), "graph": pa.array([packed], pa.binary())})

    # a graph goes out once with each block of queries, of which there are few
    spread = nodes.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.element_at("ids", 1).alias("key"))
    graphs = spread.groupBy("shard").applyInArrow(build, "shard int, graph binary")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(q=_matrix(part["v"], width), ids=np.array(part["vec_id"].to_pylist(), np.int64))], pa.binary())], ["queries"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, queries in zip(b["graph"], b["queries"], strict=True):
                g, asked = np.load(io.BytesIO(raw.as_py())), np.load(io.BytesIO(queries.as_py()))
                x, q, ids, ends = g["x"], asked["q"], g["ids"], g["ends"]
                starts = np.concatenate(([0], ends[:-1]))
                graph = Graph((np.column_stack((x, g["rest"])) / lift).astype(np.float32), [g[f"layer{i}"] for i in range(sum(f.startswith("layer") for f in g.files))], 0)
                out = ([], [], [])
                for at in range(0, len(q), WALK):
                    part = q[at : at + WALK]
                    hits = graph.search(np.column_stack((part, np.zeros(len(part)))).astype(np.float32), min(int(g["ef"]), len(x)))
                    for own_id, v, hit in zip(asked["ids"][at : at + WALK].tolist(), part, hits, strict=True):
                        hit = hit[hit >= 0]
                        rows = np.concatenate([ids[starts[h] : ends[h]] for h in hit])
                        score = np.repeat(x[hit] @ v, ends[hit] - starts[hit])
                        rows, score = rows[rows != own_id], score[rows != own_id]
                        best = np.lexsort((rows, -score))[:k]
                        for o, a in zip(out, (np.full(len(best), own_id), rows[best], score[best]), strict=True):
                            o.append(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in out], ["query_id", "vec_id", "score"])

    queries = own.filter(F.col("vec_id") % every == 0).select("vec_id", "v").repartition(max(1, -(-n // (every * QUERY_BLOCK)))).mapInArrow(block, "queries binary")
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = graphs.join(asked, "shard").select("graph", "queries").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
