"""The corpus operators against brute force on small tables, with odd rows among them."""

import hashlib
import math
import os
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mosaicq.llm import ann, components, decontaminate, lines, lm, mixing, paragraphs, quality, repeats, simhash, suffixes, token_files
from mosaicq.llm.common import slices

WORD = mixing.WORD


def roots(n, links):
    parent = list(range(n))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def tokens(text):
    return (text or "").encode().lower().split()


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100, 100), (7, 7)]
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    want = roots(101, edges)
    linked = {k for a, b in edges if a != b for k in (a, b)}
    assert got == {k: want[k] for k in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# token files --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return token_files.default_tokenizer()


def test_token_files_round_trip(make, prose, tokenizer):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    docs = make(prose + ["<|endoftext|> x", "日本 а б"])
    files = token_files.write(docs, tokenizer)
    got = {r.doc_id: r for r in token_files.read(files).collect()}
    start = 0
    for k, text in enumerate(prose + ["<|endoftext|> x", "日本 а б"]):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), k
        start += len(ids)
    assert sum(r.n_tokens for r in files.collect()) == start


def test_pieces_encode_as_the_library_encodes_whole_texts(tokenizer):
    """Texts that are cut in every way the encoder knows, and every character it takes as plain, against the library as it comes."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    rng = random.Random(1)
    odd = ["a", "b", "'s", "1", "é", "ß", "\t", "\n", " ", " ", "\n", "ab", " ", "!", "<|endoftext|>", "\x00", "\x01", "日", "\xa0", "\x85", "'", "'ll", "\r", "²", "ȳ"]
    texts = ["".join(rng.choice(odd[:n]) for _ in range(rng.randint(0, 12))) for n in (14, len(odd)) for _ in range(5000)]
    plain = [chr(c) for c in [*range(9, 127), *range(161, 173), *range(174, 564)]]
    texts += [x.format(c) for c in plain for x in ("{0}a", "{0} b", "{0}\nc", "{0}'s", "x{0}1{0}b1", "x{0} {0}b", "x{0}\n{0}.", "x{0}", "word{0}{0} y")]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    own = Tokenizer.from_file(tokenizer)
    with open(tokenizer) as f:
        got = list(token_files.Encoder(f.read()).encode(pa.array([t or "" for t in texts])))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == [*own.encode(text or "", add_special_tokens=False).ids, 2], text


def test_encoding_holds_little_at_once(tokenizer):
    words = [f"w{k % 997}x{k % 13}" for k in range(120_000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([" ".join(words)] * 9, pa.large_string())})
    with open(tokenizer, encoding="utf-8") as f:
        encoder = token_files.Encoder(f.read())
    tracemalloc.start()
    for part in slices(batch, token_files.STEP):
        assert sum(1 for _ in encoder.encode(part["text"])) == part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_token_files_hold_independent_checked_frames(tmp_path, make, tokenizer):
    import zstandard

    files = token_files.write(make(["one two", "three", None]), tokenizer, str(tmp_path)).orderBy("shard").collect()
    path = files[0]["file"].removeprefix("file://")
    some = {r["file"] for r in files}
    found = {}
    for f in some:
        found |= token_files.documents(f.removeprefix("file://"), [1])
    assert found[1][-1] == 2 and len(found) == 1
    raw = bytearray(open(path, "rb").read())
    assert b"".join(zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).readall() for _ in (0,))
    with token_files._open(f"file://{path}", "r") as f:
        r = token_files.Reader(f)
        at = int(r.offsets[1]) + int(r.entries[1, 0]) - 6
    raw[at] ^= 0xFF
    open(path, "wb").write(raw)
    with token_files._open(f"file://{path}", "r") as f, pytest.raises(Exception):
        token_files.Reader(f).ids(0)


def test_token_files_take_empty_tables_null_ids_and_repeated_rows(make, tokenizer):
    assert token_files.read(token_files.write(make([]), tokenizer)).count() == 0
    got = token_files.read(token_files.write(make(["b", "a", "a"], ids=[3, None, 3]), tokenizer)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 3, 3] and [r.start for r in got] == [0, 2, 4]


# near-duplicates -----------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = tokens(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_matches_brute_force(make, prose):
    got = {r.doc_id: r for r in simhash.near_duplicates(make(prose)).collect()}
    prints = [brute_fingerprint(t) for t in prose]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = roots(len(prints), links)
    assert [got[k].fp & (1 << 64) - 1 for k in range(len(prose))] == prints
    assert [got[k].component_id for k in range(len(prose))] == want


def test_simhash_lists_link_exactly_when_long_and_short():
    rng = np.random.default_rng(3)
    base = np.uint64(0x123456789ABC0000)
    members = base | np.unique(rng.integers(0, 1 << 12, 700)).astype(np.uint64)
    a, b = simhash._links(members)
    want = {(int(x), int(y)) for i, x in enumerate(members) for y in members[i + 1 :] if int(x ^ y).bit_count() <= 2}
    assert {tuple(sorted((int(x), int(y)))) for x, y in zip(a, b)} == want
    a, b = simhash._links(members[:50])
    assert {tuple(sorted((int(x), int(y)))) for x, y in zip(a, b)} == {p for p in want if p[0] in members[:50] and p[1] in members[:50]}


def test_first_of_group_keeps_one_and_all_columns(make, prose):
    docs = make([*prose, prose[1]], ids=[*range(len(prose)), 1])
    left = simhash.first_of_group(docs)
    assert left.columns == docs.columns
    named = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(named.values()))
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.first_of_group(make(["x", "x"], ids=[None, 4])).count() == 2


# decontamination -----------------------------------------------------------------------------------------------------


def brute_tiles(doc, item, least):
    """Longest common free runs, one at a time; first in the document, then the item, among equals."""
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and fd[d + k] and fi[i + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (d, i, k)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            fd[best[0] + k] = fi[best[1] + k] = False


def covers(text, item, least=5):
    """Whether the plain tiling of a text marks 80 % of an item's words."""
    doc, own = decontaminate.words(text), decontaminate.words(item)
    least = min(least, len(own))
    seeds = {tuple(own[i : i + least]) for i in range(len(own) - least + 1)}
    if not own or not any(tuple(doc[i : i + least]) in seeds for i in range(len(doc) - least + 1)):
        return False
    known = {}
    ids = [np.array([known.setdefault(w, len(known)) for w in x]) for x in (own, doc)]
    return sum(t[2] for t in decontaminate.tile(ids[1], ids[0], least)) >= 0.8 * len(own)


def test_tiling_covers_what_brute_force_covers():
    rng = np.random.default_rng(5)
    for _ in range(60):
        item = rng.integers(0, 30, rng.integers(5, 60))
        cut = np.sort(rng.integers(0, len(item), 2))
        doc = np.concatenate((rng.integers(0, 30, 9), item[cut[1] :], rng.integers(40, 50, 3), item[: cut[1]], rng.integers(0, 30, 9)))
        got = decontaminate.tile(doc, item)
        assert sum(t[2] for t in got) == sum(t[2] for t in brute_tiles(doc.tolist(), item.tolist(), 5))
        assert all((doc[d : d + n] == item[i : i + n]).all() for d, i, n in got)


def test_leaks_are_found_reordered_and_clean_documents_stay(spark, make):
    w = [f"w{k}" for k in range(40)]
    item = " ".join(w)
    texts = ["x y " + item.upper() + " z", " ".join(w[20:] + ["q"] + w[:20]), " ".join(w[:10]), "only other words here", None, "", "one two three", item.replace(" ", ", ")]
    bench = spark.createDataFrame([(1, item), (2, "one two three"), (3, None), (4, "  ")], "item_id long, text string")
    docs = make(texts)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(0, 1), (1, 1), (6, 2), (7, 1)}
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, 4, 5}
    none = bench.limit(0)
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == 8
    assert decontaminate.leaks(make([]), bench).count() == 0


# lines ---------------------------------------------------------------------------------------------------------------


def grams(line):
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


def test_lines_match_brute_force(make, prose):
    texts = prose + ["\n".join(f"{'alpha beta gamma delta epsilon zeta eta theta iota kappa ' * 3}{'end' + str(k % 2)}" for k in range(30))]
    texts += [f"one common start of a rather long line that goes on and on for many words until it ends with {k}" for k in range(40)]
    got = {(r.doc_id, r.line_no): (r.holder, r.kept) for r in lines.repeated_lines(make(texts)).collect()}
    at = defaultdict(list)
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                at[line.strip(" ")].append((d, n))
    known = list(at)
    sets = [grams(x) for x in known]
    links = [(i, j) for i in range(len(known)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups = defaultdict(list)
    for k, r in enumerate(roots(len(known), links)):
        groups[r] += at[known[k]]
    want = {p: (min(g)[0], p == min(g)) for g in groups.values() if len(g) > 1 for p in g}
    assert got == want


def test_lines_are_cut_from_texts(make):
    docs = make(["a b c\nkeep\n\na b c", "a b c\nother", None, ""])
    out = {r.doc_id: r.text for r in lines.without_repeats(docs).collect()}
    assert out == {0: "a b c\nkeep\n", 1: "other", 2: None, 3: ""}
    assert lines.without_repeats(docs).columns == docs.columns
    assert lines.repeated_lines(make([])).count() == 0


def test_line_plans_hold_no_python(make, prose):
    plan = lines.repeated_lines(make(prose))._jdf.queryExecution().toString() + mixing.mix(make(prose))._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))


# quality -------------------------------------------------------------------------------------------------------------


def test_classifier_learns_and_holds_out(spark, make):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["the", "river", "runs", "slowly", "past", "old", "mills."], 40)).capitalize() for _ in range(150)]
    bad = ["BUY!! " * int(rng.integers(5, 30)) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, ""]
    labels = spark.createDataFrame([(k, (k + 1) % 2, 0) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = make(texts)
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(rows) == 302 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [k for k in range(300) if rows[k].held_out]
    assert {k for k in rows if rows[k].held_out} == {k for k in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([rows[k].predicted == (k + 1) % 2 for k in held]) > 0.97
    left = quality.accepted(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, r in rows.items() if r.predicted}
    blind = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, blind).collect()} == {0.5}


def test_trees_walk_like_a_loop():
    rng = np.random.default_rng(8)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality.Trees.fit(x, y, trees=10)
    for row, got in zip(x[:50], model.score(x[:50])):
        raw = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            for _ in range(quality.DEPTH):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            raw += leaf[k - (2**quality.DEPTH - 1)]
        assert abs(got - 1 / (1 + math.exp(-raw))) < 1e-12
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


# language model ------------------------------------------------------------------------------------------------------


def test_scores_match_a_plain_model(make, prose):
    docs = make(prose)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    text = {k: [*tokens(t), b"</s>"] for k, t in enumerate(prose)}
    train = [k for k in text if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for k in train for w in text[k])
    n, v = sum(c.values()), len(c)
    grams = {2: Counter(), 3: Counter()}
    for k in train:
        w = [b"<s>", b"<s>", *text[k]]
        for i in range(2, len(w)):
            grams[2][tuple(w[i - 1 : i + 1])] += 1
            grams[3][tuple(w[i - 2 : i + 1])] += 1
    count = lambda g: (len(train) if set(g) == {b"<s>"} else c[g[0]] if len(g) == 1 else grams[2][g])
    for k, own in text.items():
        w, base, total = [b"<s>", b"<s>", *own], 0.0, 0.0
        for i in range(2, len(w)):
            p = (c[w[i]] + 1) / (n + v + 1)
            base += math.log10(p)
            for order in (2, 3):
                context = tuple(w[i - order + 1 : i])
                if count(context):
                    p = (grams[order][(*context, w[i])] + lm.MASS[order] * p) / (count(context) + lm.MASS[order])
            total += math.log10(p)
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(c[x] > 0 for x in own), n, k not in train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total, rel=1e-9)
    assert lm.score(make([])).count() == 0


# repeats -------------------------------------------------------------------------------------------------------------


def test_suffix_arrays_sort_to_their_depth():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 40, 900):
        for letters in (1, 2, 5, 256):
            t = rng.integers(0, letters, n).astype(np.uint8)
            b, order = t.tobytes(), suffixes.suffix_array(t)
            assert [b[i : i + 56] for i in order] == sorted(b[i : i + 56] for i in range(n))
            wanted = rng.random(n) < 0.3
            some = [int(i) for i in suffixes.suffix_array(t, wanted) if wanted[i]]
            assert [b[i : i + 56] for i in some] == sorted(b[i : i + 56] for i in np.flatnonzero(wanted))


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeats_match_brute_force(make, prose, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = prose + ["é" * 60, "x" + "é" * 60, "ab" * 200, "ab" * 100, "z" * 49, "z" * 50, "z" * 51]
    got = {r.doc_id: r for r in repeats.remove_repeats(make(texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    first = {}
    for d, b in enumerate(raw):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], d)
    for d, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256, bytes(got[d].kept)) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept), d
    assert repeats.remove_repeats(make([])).count() == 0


def test_common_texts_lose_their_copies_at_once(make):
    texts = ["s" * 60] * 150 + ["t" * 20] * 120 + ["s" * 70]
    got = {r.doc_id: r for r in repeats.remove_repeats(make(texts)).collect()}
    assert got[0].n_removed == 0 and all(got[k].n_removed == 60 for k in range(1, 150)) and got[270].n_removed == 70
    assert all(got[k].n_removed == 0 for k in range(150, 270)) and len(got) == 271


# mixing --------------------------------------------------------------------------------------------------------------


def water(sizes, weights, epochs=3):
    total, full = sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(epochs * s for s, f in zip(sizes, full) if f)
        open_ = sum(w for w, f in zip(weights, full) if not f)
        time = left / open_ if open_ else 0
        over = [k for k, (s, w, f) in enumerate(zip(sizes, weights, full)) if not f and w * time > epochs * s + 1e-9]
        if not over:
            return [epochs * s if f else w * time for s, w, f in zip(sizes, weights, full)]
        for k in over:
            full[k] = True


def test_targets_and_shares(make):
    rng = np.random.default_rng(6)
    names = ["a", "B", "é", None, "c", "d"]
    texts, sources = [], []
    for name, n in zip(names, (3, 300, 40, 25, 600, 2)):
        for _ in range(n):
            texts.append("w " * int(rng.integers(0, 60)))
            sources.append(name)
    texts += [None, "", "\t"]
    sources += ["c", "a", None]
    docs = make(texts, sources)
    rows = mixing.shares(docs).collect()
    assert len(rows) == len(texts)
    order = sorted({s for s in sources if s is not None}) + [None]
    size = {s: sum(len((t or "").split()) for t, o in zip(texts, sources) if o == s) for s in order}
    want = dict(zip(order, water([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == size[s]
        assert r.target == pytest.approx(want[s], rel=1e-9) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in order)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.shares(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect() if (r.text or "").split()) == {r.doc_id: r.taken // r.size for r in rows if r.taken}
    assert mixing.shares(make([])).count() == 0 and mixing.mix(make([])).count() == 0
    assert {r.taken for r in mixing.shares(make(["", None])).collect()} == {0}


# neighbours ----------------------------------------------------------------------------------------------------------


def test_neighbours_are_exact_in_score_and_good_in_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[100:160] = x[100]  # a common vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None]), (2080, [float("inf")] * 16), (None, x[0].tolist())]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=300).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in {v for _, v, _ in own}
        assert all(abs(s - x[v] @ x[q]) < 1e-9 for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        order = np.lexsort((np.arange(900), -(x @ x[q])))
        hits += len({v for _, v, _ in own} & set([k for k in order.tolist() if k != q][:20]))
    assert hits >= 0.95 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r["rank"]) for r in ann.nearest(few).collect()] == [(0, 1, 1)]
    assert ann.nearest(few.limit(0)).count() == 0


# paragraphs ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("crowded", [2000, 3])
def test_paragraphs_match_brute_force(make, prose, monkeypatch, crowded):
    monkeypatch.setattr(paragraphs, "CROWDED", crowded)
    base = ("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua " * 3).split()
    texts = prose + [" ".join(base[:k] + [f"v{k}"] + base[k:]) for k in range(12)]
    got = paragraphs.repeated_units(make(texts)).collect()
    units = []
    for d, t in enumerate(texts):
        at = 0
        for line in (t or "").encode().lower().split(b"\n"):
            w = line.split()
            if len(w) >= paragraphs.MIN_WORDS:
                units.append((d, at, at + len(w), tuple(w)))
            at += len(w)
    sets = [frozenset(u[3][k : k + 5] for k in range(len(u[3]) - 4)) for u in units]
    links = [(i, j) for i in range(len(units)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups = defaultdict(list)
    for u, r in zip(units, roots(len(units), links)):
        groups[r].append(u[:3])
    want = {(*m, min(g)[0]) for g in groups.values() if len({m[0] for m in g}) > 1 for m in g}
    assert {(r.doc_id, r.start, r.end, r.holder) for r in got if r.kind == "paragraph"} == want
    passages = defaultdict(set)
    for d, t in enumerate(texts):
        w = tokens(t)
        for k in range(len(w) - 50):
            passages[tuple(w[k : k + 51])].add(d)
    shared = {d for s in passages.values() if len(s) > 1 for d in s}
    assert shared <= {r.doc_id for r in got if r.kind == "piece"}
    for r in got:
        if r.kind == "piece":
            piece = b" ".join(tokens(texts[r.doc_id])[r.start : r.end])
            assert piece in b" ".join(tokens(texts[r.holder])) and r.removed == (r.doc_id > r.holder)
    assert paragraphs.repeated_units(make([])).count() == 0
    assert paragraphs.repeated_units(make([None, "", "short"])).count() == 0


# the pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    accepted = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    text = {r.doc_id: r.text for r in docs.collect()}
    first = sorted(accepted)
    prints = {d: brute_fingerprint(text[d]) for d in first}
    root = roots(len(first), [(i, j) for i in range(len(first)) for j in range(i) if (prints[first[i]] ^ prints[first[j]]).bit_count() <= 2])
    unique = {first[r] for r in root}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d for d in unique if not any(covers(text[d], i) for i in items)}
    size = {d: len(text[d].split()) for d in clean}
    rows = corpus_pipeline.run(spark, sf).collect()
    used = Counter(r.doc_id for r in rows)
    assert set(used) <= clean and max(used.values()) <= 3
    assert abs(sum(size[d] * n for d, n in used.items()) - sum(size.values())) < 0.1 * sum(size.values())
    assert [r.start for r in sorted(rows, key=lambda r: r.start)] == np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]])[:-1].tolist()


def test_word_pattern_is_the_bytes_split():
    import re

    text = "a\x1cb c d\te\x0bf g"
    assert re.findall(WORD, text) == [w.decode() for w in text.encode().split()]


def test_crowded_lines_are_split_and_joined_by_rare_shingles(make, monkeypatch):
    """Small limits send every route through the crowded paths; the links must be those of brute force."""
    monkeypatch.setattr(lines, "CROWDED", 2)
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base[:k] + [f"v{k}"] + base[k + 1 :]) for k in range(0, 40, 3)] + [" ".join(f"q{j}x{k}" for k in range(6)) + " of the end" for j in range(30)] + [" ".join(base)]
    got = {(r.doc_id, r.line_no): r.holder for r in lines.repeated_lines(make(texts)).collect()}
    sets = [grams(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups = defaultdict(list)
    for k, r in enumerate(roots(len(texts), links)):
        groups[r].append(k)
    assert got == {(k, 0): min(g) for g in groups.values() if len(g) > 1 for k in g}


def test_rare_shingles_find_all_near_sets(spark):
    rng = np.random.default_rng(12)
    sets = [sorted({int(x) for x in rng.integers(0, 25, rng.integers(1, 14))}) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(sets)), "key long, set array<int>")
    near = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    got = {(r.a, r.b) for r in lines._rare_pairs(df).distinct().collect() if near(r.a, r.b)}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert got == want


def test_lines_with_a_wrong_character_are_near_by_plain_character_shingles(make):
    line = "the committee will publish its annual report on the state of the harbour"
    texts = [line, line.replace("annual", "annval"), line.replace("annual", "monthly"), "été à la mer où naît 🌊 l'écume blanche", "été à la mer où naît 🌊 l'écume blanchi", "ab", "ac"]
    sets = [grams(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert near == [(1, 0), (4, 3)]
    assert {(r.doc_id, r.holder) for r in lines.repeated_lines(make(texts)).collect()} == {(0, 0), (1, 0), (3, 3), (4, 3)}
    held = make(texts).select("text", lines.shingles(F.col("text")).alias("set")).collect()
    assert [len(r["set"]) for r in held] == [len(s) for s in sets]


@pytest.mark.parametrize("small", [1, 3])
def test_crowded_bands_lose_no_link(spark, make, monkeypatch, small):
    """Lines of which each is near the next alone, so pivots part neighbours; with all bands crowded the components must be those of brute force."""
    monkeypatch.setattr(lines, "CROWDED", small)
    rng = np.random.default_rng(3)
    letter = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    texts = []
    for _ in range(5):
        parts = [letter(8) for _ in range(12)]
        for k in range(12):
            parts = parts[:k] + [letter(4) + parts[k][4:]] + parts[k + 1 :]
            texts.append(" ".join(parts))
    docs = make(texts)
    sets = [grams(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    once = lines.signatures(docs).withColumn("p0", F.lit(0).cast("long"))  # one band of all lines
    key = {r.key: r.doc_id for r in lines.lines(docs).collect()}
    found = [(key[r.a], key[r.b]) for r in lines.links(once, docs).collect()]
    assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in near}
    assert roots(len(texts), found) == roots(len(texts), near)


def test_few_pairs_at_the_similarity_share_no_band(make):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(4000):
        line = rng.choice(list("abcdefghijklmnop"), 100)
        near = line.copy()
        near[[30, 70]] = "z"
        texts += ["".join(line), "".join(near)]
    x, y = grams(texts[0]), grams(texts[1])
    assert 0.8 <= len(x & y) / len(x | y) < 0.82
    docs = make(texts)
    of = lines.lines(docs).select("key", F.expr("doc_id div 2").alias("pair"))
    shared = lines._bands(lines.signatures(docs)).join(of, "key").groupBy("pair", "band").count().filter("count = 2")
    assert 4000 - shared.select("pair").distinct().count() <= 4000 * 0.002


def test_lines_that_share_a_crowded_band_alone_are_linked(spark, make, monkeypatch):
    """A split of the band by further bands would part them."""
    monkeypatch.setattr(lines, "CROWDED", 1)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefghijklmnop"), 100)) for _ in range(6)]
    docs = make([t + end for t in texts for end in ("y", "z")])
    key = {r.doc_id: r.key for r in lines.lines(docs).collect()}
    own = {r.key: r for r in lines.signatures(docs).collect()}
    rows = []
    for k in range(0, 12, 2):
        r, other = own[key[k]].asDict(), own[key[k + 1]].asDict()
        rows += [r, other | {p: r[p] ^ (p != "p0") for p in lines._PACKED}]  # a minimum of each band but the first differs
    once = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
    found = {tuple(sorted((r.a, r.b))) for r in lines.links(once, docs).collect()}
    assert found == {tuple(sorted((key[k], key[k + 1]))) for k in range(0, 12, 2)}


def test_lines_that_are_no_candidates_are_not_stored(make, monkeypatch):
    """Lines that share one band and agree in nothing else: none of their texts is gathered, and nothing stored stays behind."""
    rng = np.random.default_rng(8)
    docs = make(["".join(rng.choice(list("abcdefghijklmnop"), 100)) for _ in range(6)])
    once = lines.signatures(docs).withColumn("p0", F.lit(0).cast("long"))
    stored, texts, files = lines.stored, [], []

    def noted(df):
        out = stored(df)
        files.extend(out.inputFiles())
        if "line" in out.columns:
            texts.extend(r["line"] for r in out.collect())
        return out

    monkeypatch.setattr(lines, "stored", noted)
    assert lines.links(once, docs).count() == 0
    assert files and not any(os.path.exists(f.removeprefix("file:")) for f in files)
    assert texts == []


def test_agreement_counts_equal_bytes(spark):
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 1 << 15, (40, 56))
    rows[1::2] = np.where(rng.random((20, 56)) < 0.6, rows[::2], rows[1::2])
    rows[3], rows[5] = rows[2], rows[4] ^ 0xFF
    packed = [[k, *(sum(int(v) << 16 * j for j, v in enumerate(r[4 * i : 4 * i + 4])) for i in range(14))] for k, r in enumerate(rows)]
    short = lines._short(spark.createDataFrame(packed, ["key", *lines._PACKED]))
    assert not any(f.nullable for f in short.schema if f.name != "key")  # no test for null in each comparison
    got = short.alias("x").join(short.alias("y"), F.expr("y.key = x.key + 1")).select("x.key", lines._agreement("x", "y").alias("n")).collect()
    assert {r.key: r.n for r in got} == {k: int(((rows[k] ^ rows[k + 1]) & 0xFF == 0).sum()) for k in range(39)}


def test_paragraphs_of_few_words_are_units(make):
    verse = "shall i compare thee to a summers day"
    texts = [f"{verse}\nonly here one\nto be or not", "To be  or not\nanother line", verse + "\nsomething else again", " ".join(["shall"] + verse.split()[1:] + ["now"]) + "\nto be or"]
    got = {(r.doc_id, r.kind, r.start, r.end, r.holder, r.removed) for r in paragraphs.repeated_units(make(texts)).collect()}
    assert got == {(0, "paragraph", 0, 8, 0, False), (2, "paragraph", 0, 8, 0, True), (3, "paragraph", 0, 9, 0, True), (0, "short", 11, 15, 0, False), (1, "short", 0, 4, 0, True)}
