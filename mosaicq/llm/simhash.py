"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share at least
SHARED = 6 positional bytes, and at least FIXED = 5 of those at the first seven positions. The index has a list for every
choice of five of these positions with their five bytes: a list for a single byte would hold 1/256 of all fingerprints, one
for five holds 2**24 at most, whatever the input. Pairs that meet in a list get their tally of shared positional bytes over
all eight positions, those below the minimum go, the rest are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicq.llm.common import cut, table, texts
from mosaicq.llm.components import components
from mosaicq.llm.filters import free_name, without

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Positional bytes that near fingerprints share at least, and those that an index list fixes, of the first seven.
SHARED, FIXED = 8 - MAX_BITS, 7 - MAX_BITS
#: Lists up to this length are compared pair by pair, longer ones by flipping bits; both are exact.
PAIRWISE = 256


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64 values."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # for bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    set_bits, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        hashes = np.fromiter((xxh64_intdigest(line[s:e], seed) for s, e in zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist(), strict=True)), np.uint64, stop - at)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint((t or "").encode()) for t in b["text"].to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row a document."""
    return texts(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries: a list's key is its choice of positions (above bit 40) with the bytes there."""
    choices = list(combinations(range(7), FIXED))
    for b in batches:
        own = np.ascontiguousarray(b["fp"].to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint8).reshape(-1, 8)
        keys = np.zeros((len(choices), len(own), 8), np.uint8)
        for i, at in enumerate(choices):
            keys[i, :, :FIXED] = own[:, at]
            keys[i, :, FIXED] = i
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(own.reshape(-1).view(np.int64), len(choices)))], ["key", "fp"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _tally(x: np.ndarray) -> np.ndarray:
    """Shared positional bytes of pairs whose xor is x."""
    return 8 - (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) != 0).sum(axis=1)


def _links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the distinct fingerprints of one list."""
    if len(members) <= PAIRWISE:
        i, j = np.triu_indices(len(members), 1)
    else:  # members differ in three bytes at most, so each reaches its partners by flipping one or two of those bits
        free = np.bitwise_or.reduce(members ^ members[0])
        bits = [np.uint64(1) << np.uint64(k) for k in range(64) if int(free) >> k & 1]
        masks = bits + [x | y for x, y in combinations(bits, 2)]
        order = np.argsort(members)
        ranked = members[order]
        i, j = [], []
        for mask in masks:
            other = members ^ mask
            at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
            hit = np.flatnonzero((ranked[at] == other) & (members < other))
            i.append(hit)
            j.append(order[at[hit]])
        i, j = np.concatenate(i), np.concatenate(j)
    x = members[i] ^ members[j]
    keep = _tally(x) >= SHARED
    i, j, x = i[keep], j[keep], x[keep]
    near = _popcount(x) <= MAX_BITS
    return members[i[near]], members[j[near]]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: each run of a key is one list."""
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def linked(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(k[1:] != k[:-1]) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(k)]))
        many = np.flatnonzero(ends - starts > 1)
        for at in range(0, len(many), 4096):
            a, b = [], []
            for s, e in zip(starts[many[at : at + 4096]], ends[many[at : at + 4096]], strict=True):
                x, y = _links(f[s:e].view(np.uint64))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        k = np.concatenate((rest_k, batch["key"].to_numpy(zero_copy_only=False)))
        f = np.concatenate((rest_f, batch["fp"].to_numpy(zero_copy_only=False)))
        if not len(k):
            continue
        done = int(np.searchsorted(k, k[-1]))  # the last list may go on
        if done:
            yield from linked(k[:done], f[:done])
        rest_k, rest_f = k[done:], f[done:]
    if len(rest_k):
        yield from linked(rest_k, rest_f)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints; prints: (fp), distinct."""
    posted = prints.select("fp").mapInArrow(_post, "key long, fp long")
    return posted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_match, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links of MAX_BITS bits reach.

    Texts without words have fingerprint zero and link like any other. Null text: empty. A null doc_id keeps
    its row and never names a component (null if the component has no other). Repeated rows stay as they are.
    No documents: no rows.
    """
    prints = cut(fingerprints(docs))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    member = components(links(groups))
    rooted = groups.join(member, groups.fp == member.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "n", "component_id")
    return _attach(prints, cut(named))


def _attach(prints: DataFrame, named: DataFrame) -> DataFrame:
    """Joins by fingerprint. Those with a thousandth of all rows number a thousand at most and are broadcast."""
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 1000 >= max(total, 1_000_000)
    common = F.broadcast(named.filter(hot).select("fp", F.col("component_id")))
    rare = named.filter(~hot).select("fp", "component_id")
    return prints.join(common, "fp").unionByName(prints.join(rare, "fp")).select("doc_id", "fp", "component_id")


def first_of_group(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; all columns kept.

    Of rows that share a kept doc_id one stays, that of the least text. Rows without a doc_id stay, as nothing names them.
    """
    named = cut(near_duplicates(docs))
    gone = named.filter("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    key = F.col("doc_id").cast("long")
    left = without(docs, key, gone)
    twice = cut(named.filter("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    if twice.isEmpty():
        return left
    own_key, whole = (free_name(docs, x) for x in ("m_key", "m_whole"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.coalesce(F.col("text"), F.lit("")), F.struct(*[c.cast("string") for c in columns]))
    repeated = left.withColumn(own_key, key).join(twice, F.col(own_key) == twice["key"], "left_semi")
    first = repeated.groupBy(own_key).agg(F.min_by(F.struct(*columns), order).alias(whole))
    return without(left, key, twice).unionByName(first.select(f"{whole}.*"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
