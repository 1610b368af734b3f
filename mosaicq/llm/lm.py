"""Language-model scoring with a weighted backoff automaton over smoothed n-grams.

Counts: every chunk of documents sends its distinct n-grams with their training counts to the buckets of the
n-gram key space, which add them up over all chunks and answer each chunk with the totals of its own n-grams.
That is the whole of the model that the chunk's texts can touch, whatever the size of the corpus.

Automaton: contexts seen in training are states. A state has an arc for each word seen after it, weighted by the
smoothed probability, and a failure arc to the next shorter context that costs the mass left for other words:
    p(w | u v) = (c(u v w) + K p(w | v)) / (c(u v) + K),   p(w) = (c(w) + 1) / (N + V + 1).
A text is scored in one traversal from left to right that carries the state and adds up log-probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicq.llm.common import chunk_count, chunk_of, cut, pack_chunks, release, table, text_bytes, texts, unpack_chunk
from mosaicq.llm.packed import pack_keys, pack_values, split, unpack_keys, unpack_values

ORDER = 3
#: How many observations the shorter context's estimate is worth, by order.
MASS = {2: 60.0, 3: 1.0}
#: Bytes of text whose n-grams a Python worker holds at a time.
CHUNK = 12 << 20
#: Bits of an n-gram's key beyond those that count the corpus's bytes: at every size an unseen n-gram is taken for a seen one less than once in a million.
SPARE_BITS = 17
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class Tokens:
    """The tokens of some texts, one after another, as 64-bit keys, and their n-grams."""

    def __init__(self, texts: pa.Array, order: int, bits: int = 64):
        from xxhash import xxh64_intdigest

        found = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # A-Z and the six blanks of ASCII alone
        words, at = found.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        some = pc.greater(pc.binary_length(words), 0)  # blanks at either end leave empty ones
        words, at = words.filter(some).dictionary_encode(), at[some.to_numpy(zero_copy_only=False)]
        keys = np.empty(len(words.dictionary) + 1, np.uint64)
        keys[:-1] = np.fromiter((xxh64_intdigest(w, 1) for w in words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
        keys[-1] = _END
        del found, some
        ids = np.full(len(at) + len(texts), len(words.dictionary), np.int64)  # an end after each text
        ids[np.arange(len(at)) + at] = words.indices.to_numpy(zero_copy_only=False)
        lengths = np.bincount(at, minlength=len(texts)).astype(np.int64) + 1
        del words, at
        pa.default_memory_pool().release_unused()
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.document = np.repeat(np.arange(len(texts)), lengths)
        own = keys[ids]
        within = np.arange(len(own)) - self.starts[self.document] if len(own) else np.empty(0, np.int64)
        before = [own]  # the token so many places back, or the start
        for back in range(1, order):
            shifted = np.concatenate((np.full(min(back, len(own)), _START), own[: max(0, len(own) - back)]))
            shifted[within < back] = _START
            before.append(shifted)
        #: For each order the distinct n-grams' keys, sorted, and which of them ends at each token.
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, order + 1):
            total = np.zeros(len(own) if n > 1 else len(keys), np.uint64)
            for back in range(n - 1, -1, -1):
                total = (total ^ (total >> np.uint64(31))) * _BASE + (before[back] if n > 1 else keys)
            total = (total ^ (total >> np.uint64(29))) * _MIX
            total ^= total >> np.uint64(32)
            if n > 1:  # words keep whole keys
                total &= np.uint64((1 << 64) - (1 << (64 - bits)))
                self.grams.append(np.unique(total, return_inverse=True))
            else:  # each distinct word once, and the end if there is a text
                used, place = np.unique(total[: len(keys) if len(own) else 0], return_inverse=True)
                self.grams.append((used, place[ids] if len(own) else np.empty(0, np.int64)))


def _counts(group: pa.Table, order: int, buckets: int, bits: int) -> pa.Table:
    """A chunk's rows to the buckets: its n-grams and their training counts."""
    chunk, group = group["chunk"][0].as_py(), unpack_chunk(group)
    t = Tokens(group["text"].combine_chunks(), order, bits)
    train = np.asarray(group["train"].to_pylist(), bool)[t.document]
    payload: dict[int, list[bytes]] = {}
    cuts = [(keys, np.bincount(at[train], minlength=len(keys)), split(keys, buckets)) for keys, at in t.grams]
    for b in np.flatnonzero(sum(np.diff(edges) for _, _, edges in cuts)).tolist():  # buckets that get something
        payload[b] = [x for keys, n, edges in cuts for x in (pack_keys(keys[edges[b] : edges[b + 1]]), pack_values(n[edges[b] : edges[b + 1]]))]
    return pa.table({"bucket": pa.array(list(payload), pa.int32()), "chunk": pa.array([chunk] * len(payload), pa.int32()), "sent": pa.array(list(payload.values()), pa.list_(pa.binary()))})


def _totals(group: pa.Table, order: int) -> pa.Table:
    """A bucket's answers: for each chunk the corpus totals of its n-grams, and how many words and tokens it counts."""
    group = group.sort_by([("chunk", "ascending")])
    sent, chunks = group["sent"].to_pylist(), group["chunk"].to_pylist()
    answers: list[list[bytes]] = [[] for _ in chunks]
    words = tokens = 0
    for n in range(order):
        keys = [unpack_keys(s[2 * n]) for s in sent]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack_values(s[2 * n + 1]) for s in sent]), len(distinct)).astype(np.int64)
        if n == 0:
            words, tokens = int((total > 0).sum()), int(total.sum())
        for a, own in zip(answers, np.split(total[at], np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            a.append(pack_values(own))
    first = [k == 0 for k in range(len(chunks))]
    return pa.table({
        "chunk": pa.array(chunks, pa.int32()), "bucket": group["bucket"].combine_chunks().cast(pa.int32()), "totals": pa.array(answers, pa.list_(pa.binary())),
        "words": pa.array([words * f for f in first], pa.int64()), "tokens": pa.array([tokens * f for f in first], pa.int64()),
    })


class Automaton:
    """States, arcs and failure arcs that some texts can touch, shared by them and numbered by n-gram; weights are log10.

    A state of depth d is a context of d tokens that training holds. Its arcs are the (d + 1)-grams that go on from it: arc[d] has their
    weights, seen[d] which of them training holds. fail[d] has, by the same numbers, what it costs to fall from an arc's
    state to the state of its context less the first token. ask[d] tells the arc of depth d that each token asks for.
    """

    def __init__(self, t: Tokens, counts: list[np.ndarray], n_tokens: int, n_words: int, n_docs: int, mass: dict[int, float]):
        self.starts, self.ends, self.top = t.starts, t.ends, len(counts) - 1
        self.ask = [at for _, at in t.grams]
        opens = np.zeros(len(t.document), bool)
        opens[t.starts] = True
        p = (counts[0] + 1.0) / (n_tokens + n_words + 1.0)
        self.seen, self.arc, self.fail = [counts[0] > 0], [np.log10(p)], [np.zeros(len(p))]
        for d in range(1, len(counts)):
            token = np.empty(len(counts[d]), np.int64)  # one at which each n-gram ends
            token[self.ask[d]] = np.arange(len(self.ask[d]))
            context = np.where(opens[token], n_docs, counts[d - 1][self.ask[d - 1][token - 1]])  # a text's first context is its start
            shorter, own = p[self.ask[d - 1][token]], counts[d]
            p = np.where(context > 0, (own + mass[d + 1] * shorter) / (context + mass[d + 1]), shorter)
            self.seen.append(own > 0)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(mass[d + 1] / (context + mass[d + 1])))
        self.begin = self.top if n_docs else 0
        self.base, self.known = self.arc[0][self.ask[0]], self.seen[0][self.ask[0]]

    def score(self, document: int) -> float:
        """Traverses one document, carrying the state's depth: arcs where the state has one, failure arcs until it has."""
        part = slice(self.starts[document], self.ends[document])
        ask = [a[part] for a in self.ask]
        seen, arc, fail = ([x[a].tolist() for x, a in zip(own, ask, strict=True)] for own in (self.seen, self.arc, self.fail))
        total, depth, top = 0.0, self.begin, self.top
        for i, known in enumerate(seen[0]):
            while depth and not seen[depth][i]:
                total += fail[depth][i]
                depth -= 1
            total += arc[depth][i]
            if depth < top:  # the next state: what was matched, if training knows it
                depth = depth + 1 if depth or known else 0
        return total


def score(docs: DataFrame, order: int = ORDER, mass: dict[int, float] | None = None, modulus: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Null text: empty, the end token alone. A null doc_id is not held out. Repeated rows count and score each. With no
    training documents every word has probability 1. No documents: no rows.
    """
    mass = mass or MASS
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held
    own = texts(docs).select("doc_id", "text", F.coalesce(~left, F.lit(True)).alias("train"))
    total = text_bytes(own)
    n, bits = chunk_count(total, CHUNK), min(64, -(-(total.bit_length() + SPARE_BITS) // 8) * 8)
    chunks = pack_chunks(own.withColumn("chunk", chunk_of(n, "doc_id", "text")), level=9).repartitionById(n, F.col("chunk"))  # a partition a chunk
    sent = chunks.groupBy("chunk").applyInArrow(lambda g: _counts(g, order, n, bits), "bucket int, chunk int, sent array<binary>")
    answers = cut(sent.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInArrow(lambda g: _totals(g, order), "chunk int, bucket int, totals array<binary>, words long, tokens long"))
    release(docs.sparkSession)
    words, tokens = answers.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    n_docs = own.filter("train").count()
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def run(group: pa.Table, totals: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        group = unpack_chunk(group)
        t = Tokens(group["text"].combine_chunks(), order, bits)
        parts = totals.sort_by([("bucket", "ascending")])["totals"].to_pylist()
        counts = [np.concatenate([unpack_values(p[k]) for p in parts]) for k in range(order)]
        model = Automaton(t, counts, tokens, words, n_docs, mass)
        return pa.table([
            group["doc_id"].combine_chunks(), pa.array([not x for x in group["train"].to_pylist()], pa.bool_()), pa.array(t.ends - t.starts, pa.int64()),
            pa.array(np.add.reduceat(model.known.astype(np.int64), t.starts)), pa.array([tokens] * group.num_rows, pa.int64()),
            pa.array(np.add.reduceat(model.base, t.starts)), pa.array([model.score(i) for i in range(group.num_rows)], pa.float64()),
        ], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.repartitionById(n, F.col("chunk")).groupBy("chunk")).applyInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
