"""Suffix-array de-duplication: bytes under a string of LENGTH bytes that a document of smaller doc_id also holds.

Equal strings of LENGTH bytes hold equal GRAM-byte pieces, so they have the same least piece hash. First every chunk of
documents sends the distinct least hashes of its strings and learns which of them other documents share. Then it
sends the stretches of text whose strings have a shared one to buckets by that hash, equal stretches once, with the
least doc_id that holds them. A bucket sorts the suffixes of its stretches by two-stage sorting, finds equal strings by
the common prefixes of neighbours, and answers with one bit a string: whether a smaller doc_id holds it. Bits and texts
meet again chunk by chunk. Strings under a hash that HOT documents share go to buckets by their own bytes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicq.llm.common import Places, by_chunk, chunk_count, chunk_of, cut, pack_chunks, release, table, text_bytes, texts, unpack_chunk
from mosaicq.llm.packed import pack_keys, pack_values, split, unpack_keys, unpack_values
from mosaicq.llm.suffixes import common_prefixes, suffix_array

LENGTH, GRAM = 50, 20
HOT = 1000
#: Bytes of text that a Python worker holds at a time.
CHUNK = 8 << 20
#: Bytes hashed, and bytes of stretches sorted, in one go.
HASH_STEP, SORT_STEP = 1 << 20, 1 << 20
#: Stretches cut from a text in one go.
PIECES = 100_000
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-byte pieces: polynomials put together by doubling."""
    power = {1: (data.astype(np.uint64) + np.uint64(1)) * _MIX}
    size = 1
    while size * 2 <= n:
        h = power[size]
        power[size * 2] = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    total, have = power[size], size
    for part in sorted(power, reverse=True):
        while have + part <= n:
            m = len(data) - have - part + 1
            total = total[:m] * np.uint64(pow(_BASE, part, 1 << 64)) + power[part][have : have + m]
            have += part
    return _mix(total)


def _window_least(h: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = n - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Chunk:
    """The distinct texts of some documents as one byte array, in the order of doc_id and text."""

    def __init__(self, group: pa.Table):
        group = unpack_chunk(group)
        rows = sorted(zip(group["doc_id"].to_pylist(), group["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.copies: list[tuple[int | None, bytes]] = []  # of a text that a smaller doc_id has in this chunk
        first: dict[str, int | None] = {}
        self.doc_ids: list[int | None] = []
        self.raw: list[bytes] = []
        for doc_id, text in rows:
            if text in first and first[text] != doc_id:
                self.copies.append((doc_id, text.encode()))
            else:
                first[text] = doc_id
                self.doc_ids.append(doc_id)
                self.raw.append(text.encode())
        self.rank = np.array([np.iinfo(np.int64).min if d is None else d for d in self.doc_ids], np.int64)
        self.ends = np.cumsum([len(r) for r in self.raw], dtype=np.int64)
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of successive strings with one least hash: first string, strings, document, hash."""
        found = []
        for a in range(0, len(self.data) - LENGTH + 1, HASH_STEP):
            part = self.data[a : a + HASH_STEP + LENGTH - 1]
            h = _window_least(_gram_hashes(part, GRAM), LENGTH - GRAM + 1)
            at = a + np.arange(len(h))
            doc = np.searchsorted(self.ends, at, side="right")
            inside = at + LENGTH <= self.ends[np.minimum(doc, len(self.ends) - 1)]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
            new &= inside
            first = np.flatnonzero(new)
            n = np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
            found.append((at[first], n, doc[first], _mix(h[first])))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _sent(chunk: int, rows: list[tuple[int, list[bytes]]]) -> pa.Table:
    """A chunk's rows for the buckets that it has something for, never more than it has keys."""
    return pa.table({"bucket": pa.array([k for k, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "sent": pa.array([x for _, x in rows], pa.list_(pa.binary()))})


def _sharing(group: pa.Table, buckets: int) -> pa.Table:
    """A chunk's distinct least hashes and in how many of its documents each stands, for the buckets."""
    _, _, doc, key = Chunk(group).runs()
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    keys, n = np.unique(key[new], return_counts=True)
    edges = split(keys, buckets)
    sent = [(k, [pack_keys(keys[a:b]), pack_values(n[a:b])]) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    return _sent(group["chunk"][0].as_py(), sent)


def _shared(group: pa.Table) -> pa.Table:
    """A bucket's answers, for each hash: 0 one document alone has it, 1 several, 2 HOT or more."""
    keys = [unpack_keys(s[0]) for s in group["sent"].to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate([unpack_values(s[1]) for s in group["sent"].to_pylist()]), len(distinct))
    kind = ((n >= 2).astype(np.int64) + (n >= HOT))[at]
    answers = [pack_values(k) for k in np.split(kind, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"chunk": group["chunk"].combine_chunks(), "bucket": group["bucket"].combine_chunks(), "kinds": pa.array(answers, pa.binary())})


def _pack_arrays(*arrays: np.ndarray) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _stretches(group: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """A chunk's stretches under shared hashes for the buckets, and its own notes (bucket -1) on where they stand."""
    if not group.num_rows:
        return _sent(0, [])
    from xxhash import xxh64_intdigest

    c = Chunk(group)
    start, n, doc, key = c.runs()
    keys = np.unique(key)
    kinds = np.concatenate([np.zeros(0, np.int64), *(unpack_values(k) for k in answers.sort_by([("bucket", "ascending")])["kinds"].to_pylist())])
    kind = kinds[np.searchsorted(keys, key)]
    hot = np.flatnonzero(kind == 2)
    single = np.repeat(start[hot] - np.cumsum(n[hot]) + n[hot], n[hot]) + np.arange(n[hot].sum())  # each string by itself
    some = kind == 1
    start, doc, key, n = np.concatenate((start[some], single)), np.concatenate((doc[some], np.repeat(doc[hot], n[hot]))), key[some], np.concatenate((n[some], np.ones(len(single), np.int64)))
    raw, known = b"".join(c.raw), Places()
    at = np.empty(len(start), np.int64)  # equal stretches once
    for k in range(0, len(start), PIECES):
        stop = start[k : k + PIECES] + n[k : k + PIECES] + LENGTH - 1
        at[k : k + PIECES] = np.fromiter((known[raw[a:b]] for a, b in zip(start[k : k + PIECES].tolist(), stop.tolist(), strict=True)), np.int64, len(stop))
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, at, c.rank[doc])
    of = np.zeros(len(known), np.int64)
    of[at] = np.arange(len(at))
    texts_, n_of = list(known), n[of]
    alone = np.flatnonzero(of >= len(key))  # strings by themselves go by their own bytes
    key_of = np.concatenate((key, np.zeros(len(single), np.uint64)))[of]
    key_of[alone] = np.fromiter((xxh64_intdigest(texts_[i], 3) for i in alone.tolist()), np.uint64, len(alone))
    order = np.argsort(key_of, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n_, key_ = n_of[order], key_of[order]
    edges = split(key_, buckets)
    sent = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            own = order[a:b]
            sent.append((k, _pack_arrays(key_[a:b], n_[a:b].astype(np.int32), least[own], np.frombuffer(b"".join(texts_[i] for i in own.tolist()), np.uint8))))
    notes = _pack_arrays(start, n.astype(np.int32), doc.astype(np.int32), place[at], least[at])
    return _sent(group["chunk"][0].as_py(), [(-1, notes), *sent])


def smaller_holders(pieces: list[bytes], n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of the n[i] strings at the front of each piece: whether a piece of smaller rank than its own holds it."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum([len(p) for p in pieces]) - [len(p) for p in pieces]
    first = np.cumsum(n) - n
    string = np.full(len(text), -1, np.int64)  # which string starts at a byte
    at = np.repeat(starts - first, n) + np.arange(n.sum())
    string[at] = np.arange(n.sum())
    owner = np.repeat(rank, n)
    order = suffix_array(text, string >= 0)
    order = order[string[order] >= 0]
    group = np.cumsum(common_prefixes(text, order, LENGTH) < LENGTH) - 1
    least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner[string[order]])
    out = np.zeros(len(owner), bool)
    out[string[order]] = least[group] < owner[string[order]]
    return out


def _sorted_bucket(group: pa.Table) -> pa.Table:
    """A bucket's answers: a bit for each string of each chunk's stretches."""
    chunks = group["chunk"].to_pylist()
    keys, ns, ranks, ats, sizes, known = [], [], [], [], [], Places()
    for raw in group["sent"].to_pylist():
        key, n, rank, data = (_unpack(x, kind) for x, kind in zip(raw, (np.uint64, np.int32, np.int64, np.uint8), strict=True))
        length, data = n.astype(np.int64) + LENGTH - 1, data.tobytes()
        end = np.cumsum(length)
        ats.append(np.fromiter((known[data[a:b]] for a, b in zip((end - length).tolist(), end.tolist(), strict=True)), np.int64, len(n)))
        keys.append(key), ns.append(n.astype(np.int64)), ranks.append(rank), sizes.append(len(n))
    key, n, rank, at = (np.concatenate(x) for x in (keys, ns, ranks, ats))
    texts_, m = list(known), len(known)
    least, of = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
    np.minimum.at(least, at, rank)
    of[at] = np.arange(len(at))
    order = np.argsort(key[of], kind="stable")
    length, own_key, own_n = n[of][order] + LENGTH - 1, key[of][order], n[of][order]
    held = np.zeros(own_n.sum(), bool)  # strings in the order of the sorted stretches
    first = np.cumsum(own_n) - own_n
    a, step = 0, np.cumsum(length)
    while a < m:
        b = int(np.searchsorted(step, (step[a - 1] if a else 0) + SORT_STEP)) + 1
        b = int(np.searchsorted(own_key, own_key[min(b, m) - 1], side="right"))  # a key's stretches stay together
        held[first[a] : first[b - 1] + own_n[b - 1]] = smaller_holders([texts_[i] for i in order[a:b].tolist()], own_n[a:b], least[order[a:b]])
        a = b
    base = np.empty(m, np.int64)
    base[order] = first
    answers, done = [], 0
    for size in sizes:  # equal stretches of other chunks count too
        own = slice(done, done + size)
        flags = held[np.repeat(base[at[own]] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(n[own].sum())] | np.repeat(least[at[own]] < rank[own], n[own])
        answers.append(_pack_arrays(np.packbits(flags))[0] if size else b"")
        done += size
    return pa.table({"bucket": group["bucket"].combine_chunks(), "chunk": pa.array(chunks, pa.int32()), "sent": pa.array([[x] for x in answers], pa.list_(pa.binary())), "strings": pa.array([int(x.sum()) for x in ns], pa.int64())})


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut_out(group: pa.Table, notes: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    if group.num_rows:
        c = Chunk(group)
        notes = notes.sort_by([("bucket", "ascending")])
        start, n, doc, place, least = (_unpack(x, kind) for x, kind in zip(notes["sent"][0].as_py(), (np.int64, np.int32, np.int32, np.int64, np.int64), strict=True))
        # the buckets' rows come in the order of their keys, as the stretches were placed
        flags = [np.unpackbits(_unpack(s[0], np.uint8), count=k).astype(bool) for s, k in zip(notes["sent"].to_pylist()[1:], notes["strings"].to_pylist()[1:], strict=True) if k]
        flags = np.concatenate(flags) if flags else np.zeros(0, bool)
        n = n.astype(np.int64)
        sizes = np.zeros(place.max(initial=-1) + 1, np.int64)
        sizes[place] = n
        base = np.cumsum(sizes) - sizes
        string = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        flag = flags[np.repeat(base[place] - np.cumsum(n) + n, n) + np.arange(n.sum())] | np.repeat(c.rank[doc] > least, n)
        cover = np.zeros(len(c.data) + 1, np.int32)
        np.add.at(cover, string[flag], 1)
        np.add.at(cover, string[flag] + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        for k, raw in enumerate(c.raw):
            own = gone[c.ends[k] - len(raw) : c.ends[k]]
            kept = raw if not own.any() else c.data[c.ends[k] - len(raw) : c.ends[k]][~own].tobytes()
            rows.append((c.doc_ids[k], len(raw), int(own.sum()), int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()), kept))
        rows += [(d, len(raw), *((len(raw), 1, b"") if len(raw) >= LENGTH else (0, 0, raw))) for d, raw in c.copies]
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    return pa.table([*columns, pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    A string counts only if a smaller doc_id holds it; rows that share a doc_id don't remove each other's bytes, and a
    null doc_id counts as smaller than any. Null text: empty. Texts of fewer than LENGTH bytes stay as they are.
    Kept bytes may break a character, so they are binary. No documents: no rows.
    """
    own = texts(docs).withColumn("sha", F.unhex(F.sha2("text", 256)))
    n = chunk_count(text_bytes(own), CHUNK)
    # texts with a thousandth of all rows, at most a thousand, lose their copies at once; others meet in a chunk
    total = own.count()
    groups = own.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.count("*").alias("n"))
    common = cut(groups.filter(F.col("n") * 1000 >= max(total, 100_000)).select("sha", F.col("first.doc_id").alias("first_id")))
    marked = own.join(F.broadcast(common.withColumn("common", F.lit(True))), "sha", "left")
    is_copy = F.coalesce("common", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    rest = by_chunk(pack_chunks(marked.filter(~is_copy).select("doc_id", "text", chunk_of(n, "sha").alias("chunk"))), n)
    sent = "bucket int, chunk int, sent array<binary>"
    sharing = rest.groupBy("chunk").applyInArrow(lambda g: _sharing(g, n), sent)
    kinds = cut(sharing.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInArrow(_shared, "chunk int, bucket int, kinds binary"))
    stretches = cut(rest.groupBy("chunk").cogroup(kinds.repartitionById(n, F.col("chunk")).groupBy("chunk")).applyInArrow(lambda g, a: _stretches(g, a, n), sent))
    release(docs.sparkSession)
    bits = stretches.filter("bucket >= 0").repartitionById(n, F.col("bucket")).groupBy("bucket").applyInArrow(_sorted_bucket, sent + ", strings long")
    notes = stretches.filter("bucket < 0").withColumn("strings", F.lit(0).cast("long")).unionByName(bits)
    done = rest.groupBy("chunk").cogroup(notes.repartitionById(n, F.col("chunk")).groupBy("chunk")).applyInArrow(_cut_out, _SCHEMA)
    raw = F.col("text").cast("binary")
    long = F.length(raw) >= LENGTH
    size = F.length(raw).cast("long")
    kept = F.when(long, F.lit(b"")).otherwise(raw)
    zero = F.lit(0).cast("long")
    copies = marked.filter(is_copy).select("doc_id", size.alias("n_bytes"), F.when(long, size).otherwise(zero).alias("n_removed"), F.when(long, F.lit(1).cast("long")).otherwise(zero).alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept"))
    return done.unionByName(copies)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: The same in SQL, over the texts' hexadecimal digits.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS k FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT w.doc_id, k FROM w JOIN f USING (s) WHERE least < w.doc_id),
i AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM r)),
g AS (SELECT doc_id, span, min(k) AS a, max(k) + 50 AS b FROM i GROUP BY doc_id, span),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM g GROUP BY doc_id),
keep AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM g UNION ALL SELECT g.doc_id, max(b), any_value(length(h) // 2) FROM g JOIN d USING (doc_id) GROUP BY g.doc_id),
kept AS (SELECT keep.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM keep JOIN d USING (doc_id) GROUP BY keep.doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
