"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Seeds, hashes of MIN_MATCH successive words, of items and documents are joined by key. A document that covers an item enough
holds a least number of the item's seeds, so each item is asked for by its rarest seeds alone, one more than the rest could
make up for, and a phrase that all share pairs nothing. For each pair that meets, the longest common runs of words that
overlap no earlier run are marked, longest first; the share of the item's words under the marks is its coverage. Order plays
no part, so reordered passages count too. Neither side is broadcast; a filter of fixed size spares documents' other seeds.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicq.llm.common import Places, cut, slices, table, texts
from mosaicq.llm.filters import among, key_filter, passes, without

MIN_MATCH = 5
COVERAGE = 0.8
FIRST_SEARCH = 20
WORDS = re.compile(r"\w+").findall
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n ids."""
    own = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    own ^= own >> np.uint64(32)
    total = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        total = total * _BASE + own[k : k + len(total)]
    return total


def tile(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH, where: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (doc position, item position, length) of the greedy tiling; ties go to the first in the doc, then item.

    where: doc positions at which a run of `least` words of the item starts, if known.
    """
    if len(item) < least or len(doc) < least:
        return []
    if where is None:
        where = np.flatnonzero(np.isin(windows(doc, least), windows(item, least)))
    free_doc, free_item, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []
    grams = windows(doc, least)
    search = max(least, min(FIRST_SEARCH, len(item)))
    while True:
        found, longest = _scan(doc, item, free_doc, free_item, search, least, where, grams)
        if longest > 2 * search:
            search = longest
            continue
        occluded = False
        for n, d, i in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_doc[d : d + n].all() and free_item[i : i + n].all():
                free_doc[d : d + n] = free_item[i : i + n] = False
                tiles.append((d, i, n))
            else:
                occluded = True
        if occluded:
            continue  # what is left of an overlapped match is found again
        if search <= least:
            return tiles
        search = max(least, search // 2)


def _scan(doc, item, free_doc, free_item, n, least, where, grams) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal matches of n words or more among free words; stops at one of over 2n."""
    table = defaultdict(list)
    hashes = windows(item, n)
    for i in range(len(hashes)):
        if free_item[i : i + n].all():
            table[int(hashes[i])].append(i)
    if not table:
        return [], 0
    starts = where[where + n <= len(doc)]
    if n > least and len(starts):  # a longer window starts where `least`-word runs start one after another
        seeded = np.zeros(len(grams) + 1, np.int64)
        seeded[where + 1] = 1
        seeded = seeded.cumsum()
        starts = starts[seeded[starts + n - least + 1] - seeded[starts] == n - least + 1]
    own = _hashes_at(doc, starts, n)
    found, longest, reach = [], 0, {}
    for d, h in zip(starts.tolist(), own.tolist(), strict=True):
        for i in table.get(h, ()):
            if reach.get(d - i, -1) >= d + n or not free_doc[d : d + n].all():
                continue  # inside a match already found on this diagonal
            k = 0
            while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and free_doc[d + k] and free_item[i + k]:
                k += 1
            if k < n:
                continue
            if k > 2 * n:
                return found, k
            found.append((k, d, i))
            reach[d - i] = d + k
            longest = max(longest, k)
    return found, longest


def _hashes_at(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    if not len(at):
        return np.empty(0, np.uint64)
    own = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    own ^= own >> np.uint64(32)
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * _BASE + own[at + k]
    return total


class Seeds:
    """The words of some texts as hashes, one text after another, and the seeds that start at them."""

    def __init__(self, texts: Iterable[str | None]):
        from xxhash import xxh64_intdigest

        known = Places()
        place = known.__getitem__
        parts = [np.fromiter(map(place, own), np.int64, len(own)) for t in texts for own in (words(t),)]
        of_word = np.fromiter((xxh64_intdigest(w, 7) for w in known), np.uint64, len(known))
        self.ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        self.keys = of_word[np.concatenate(parts)] if parts else np.zeros(0, np.uint64)
        self.text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(seed, text) of all runs of n words."""
        at = np.flatnonzero(np.arange(n, len(self.keys) + n) <= self.ends[self.text]) if len(self.keys) else np.zeros(0, np.int64)
        total = np.full(len(at), n, np.uint64)
        for k in range(n):
            total = total * _BASE + (self.keys[at + k] ^ (self.keys[at + k] >> np.uint64(31)))
        total = (total ^ (total >> np.uint64(32))) * _MIX
        return total ^ (total >> np.uint64(29)), self.text[at]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item, size, n, words): an item's distinct seeds of `size` words, n times each; a shorter item is one seed."""
    for b in batches:
        s, keys = Seeds(b["text"].to_pylist()), b["item"].to_numpy(zero_copy_only=False)
        length = np.diff(s.ends, prepend=0)
        for size in range(1, MIN_MATCH + 1):
            seed, text = s.of(size)
            own = length[text] >= size if size == MIN_MATCH else length[text] == size
            pairs, n = np.unique(np.stack((text[own].astype(np.uint64), seed[own])), axis=1, return_counts=True)
            text, seed = pairs[0].astype(np.int64), np.ascontiguousarray(pairs[1])
            yield pa.RecordBatch.from_arrays([_signed(seed), pa.array(keys[text], pa.int64()), pa.array(np.full(len(n), size), pa.int32()), pa.array(n, pa.int64()), pa.array(length[text], pa.int64())], ["seed", "item", "size", "n", "words"])


def _tiled(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["key"] != key:  # rows come in the documents' order
                    key, own = r["key"], words(r["text"])
                known: dict[str, int] = {}
                item = np.array([known.setdefault(w, len(known)) for w in words(r["item_text"])], np.int64)
                ids = np.fromiter((known.get(w, -1) for w in own), np.int64, len(own))
                tiles = tile(ids, item, min(MIN_MATCH, len(item)))
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(item):
                    rows.append((key, r["item"], covered, len(item), covered / len(item), len(tiles)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["key", "item", "covered", "item_words", "coverage", "tiles"])

    return run


def _key(name: str) -> Column:
    """What names a document or an item: its id and whole text."""
    return F.xxhash64(F.col(name).cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def matches(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(key, item, covered, item_words, coverage, tiles), once for each distinct document and item; both come with key and text."""
    asked = cut(items.dropDuplicates(["key"]).select("text", F.col("key").alias("item")).mapInArrow(_item_seeds, "seed long, item long, size int, n long, words long"))
    sizes = [r.size for r in asked.select(F.col("size").alias("size")).distinct().collect()]  # MIN_MATCH numbers at most
    bits = key_filter(asked.select(F.col("seed").alias("key")))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for b in slices(batch):
                s, found = Seeds(b["text"].to_pylist()), []
                for size in sizes:
                    seed, text = s.of(size)
                    hit = np.flatnonzero(passes(passing, seed))
                    found.append(np.stack((text[hit].astype(np.uint64), seed[hit])))
                pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.uint64)
                at, first = np.unique(pairs[0].astype(np.int64), return_index=True)
                own = pa.ListArray.from_arrays(pa.array(np.append(first, pairs.shape[1]), pa.int32()), _signed(np.ascontiguousarray(pairs[1])))
                yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(at)), b["text"].take(pa.array(at)), own], ["key", "text", "seeds"])

    held = cut(docs.select("key", "text").mapInArrow(seeded, "key long, text string, seeds array<long>"))
    hits = held.select("key", F.explode("seeds").alias("seed")).join(asked.select("seed").distinct(), "seed")
    often = hits.groupBy("seed").agg(F.count("*").alias("f"))
    # tiles of MIN_MATCH words or more that cover enough hold at least so many of an item's seeds
    least = F.when(F.col("size") < MIN_MATCH, 1).otherwise(F.ceil(F.ceil(F.col("words") * coverage - 1e-9) / MIN_MATCH))
    commonest = W.partitionBy("item").orderBy(F.desc("f"), "seed").rowsBetween(W.unboundedPreceding, 0)  # one item's seeds
    rare = asked.join(often, "seed").withColumn("rest", F.sum("n").over(commonest)).filter(F.col("rest") >= least).select("seed", "item")
    pairs = hits.join(rare, "seed").select("key", "item").distinct()
    whole = pairs.join(held.select("key", "text").dropDuplicates(["key"]), "key").join(items.dropDuplicates(["key"]).select(F.col("key").alias("item"), F.col("text").alias("item_text")), "item")
    schema = "key long, item long, covered int, item_words int, coverage double, tiles int"
    return whole.select("key", "item", "text", "item_text").sortWithinPartitions("key").mapInArrow(_tiled(coverage), schema)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _key("item_id").alias("key"))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, covered, item_words, coverage, tiles) for each document that covers an item enough.

    Items of fewer than MIN_MATCH words must stand whole; items without words match nothing, null or empty texts
    neither. Repeated documents and items are reported each. No benchmark or no documents: no rows.
    """
    own, items = texts(docs).withColumn("key", _key("doc_id")), _items(benchmark)
    found = cut(matches(own, items, coverage))
    named = found.join(items.select("item_id", F.col("key").alias("item")), "item")
    return named.join(_among_found(own, found).select("doc_id", "key"), "key").select("doc_id", "item_id", "covered", "item_words", "coverage", "tiles")


def _among_found(own: DataFrame, found: DataFrame) -> DataFrame:
    return among(own, F.col("key"), found.select("key"), "m_maybe").filter("m_maybe")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows that cover an item enough, all columns kept."""
    found = matches(texts(docs).withColumn("key", _key("doc_id")), _items(benchmark), coverage)
    return without(docs, _key("doc_id"), cut(found.select("key").distinct()))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
