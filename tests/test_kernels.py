"""The sequential kernels by their invariants and against plain twins."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaicq.operators import kernels as k

values = st.lists(st.integers(0, 40), min_size=1, max_size=120)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-500, 500), min_size=1, max_size=60))
def test_squeeze_is_reversible(row):
    assert k.unsqueeze(*k.squeeze(np.array(row))).tolist() == row


@settings(max_examples=60, deadline=None)
@given(values)
def test_lz_expands_to_its_input(v):
    assert k.lz_expand(k.lz_parse(v * 3)) == v * 3


@settings(max_examples=60, deadline=None)
@given(values)
def test_range_coder_round_trips(v):
    f = k.ans_counts(np.bincount(v, minlength=41).tolist())
    assert sum(f) == 4096 and all((n > 0) == (x in v) for x, n in enumerate(f))
    assert k.rans_decode(*k.rans_encode(v, f), len(v), f) == v


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=100))
def test_huffman_is_complete_and_limited(counts):
    d = k.huffman_depths(counts)
    used = sum(n > 0 for n in counts)
    assert max(d) <= 15 and sum(x > 0 for x in d) == used
    if used > 1:
        assert sum(2.0**-x for x in d if x) == 1
        order = sorted((n, x) for n, x in zip(counts, d) if n)
        assert max(d) == 15 or all(a[1] >= b[1] for a, b in itertools.pairwise(order) if a[0] < b[0])


def test_priced_parse_beats_literals():
    v = [1, 2, 3, 4, 5] * 20
    price = {x: 5.0 for x in range(6)}
    assert k.priced_parse(v, price) < 100 and k.priced_parse([1, 2, 3], price) == 15


def test_weighted_predictor_is_causal_and_learns():
    ramp = np.add.outer(np.arange(20) * 3, np.arange(32) * 2)
    e = k.weighted_residuals(ramp)
    assert np.abs(e[4:, 4:]).sum() < 0.05 * ramp[4:, 4:].sum()
    other = ramp.copy()
    other[10:] = 7
    assert (k.weighted_residuals(other)[:10] == e[:10]).all()


def test_components_and_rectangles():
    rng = np.random.default_rng(1)
    mask = rng.random((12, 14)) < 0.35
    got = k.components8(mask)
    ids = {tuple(p): i for i, p in enumerate(np.argwhere(mask).tolist())}
    seen, label = set(), {}
    for start in ids:
        if start in seen:
            continue
        todo, group = [start], []
        seen.add(start)
        while todo:
            y, x = todo.pop()
            group.append((y, x))
            for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in ids and p not in seen:
                    seen.add(p)
                    todo.append(p)
        for p in group:
            label[p] = min(y * 14 + x for y, x in group)
    assert all(got[p] == label.get(p, -1) for p in itertools.product(range(12), range(14)))
    x, y, w, h = k.largest_rectangle(~mask)
    area = max((b - a) * (d - c) for a in range(14) for b in range(a + 1, 15) for c in range(12) for d in range(c + 1, 13) if not mask[c:d, a:b].any())
    assert w * h == area and not mask[y : y + h, x : x + w].any()


def test_paths_levels_and_trellis_are_optimal():
    rng = np.random.default_rng(2)
    c = rng.random((6, 6))
    want = min(sum(c[a, b] for a, b in itertools.pairwise(p)) for p in itertools.permutations(range(6)))
    assert k.shortest_path(c)[0] == pytest.approx(want)
    v, w = np.sort(rng.random(8)), rng.random(8)
    best = np.inf
    for cuts in itertools.combinations(range(1, 8), 2):
        parts = np.split(np.arange(8), cuts)
        best = min(best, sum(((v[p] - (v[p] * w[p]).sum() / w[p].sum()) ** 2 * w[p]).sum() for p in parts))
    assert k.best_levels(v, w, 3)[0] == pytest.approx(best)
    x = rng.normal(size=7) * 2
    assert len(k.trellis(x, 0.1)) == 7 and k.trellis(x, 0.0) == [round(t) for t in x]
    assert k.trellis(x * 0.1, 5.0) == [0] * 7


def test_simplified_lines_stay_within_tolerance():
    rng = np.random.default_rng(3)
    p = np.stack((np.arange(80.0), np.cumsum(rng.normal(size=80))), axis=1)
    keep = k.simplify(p, 1.0)
    for a, b in itertools.pairwise(keep):
        d = p[b] - p[a]
        for q in p[a:b]:
            t = np.clip((q - p[a]) @ d / (d @ d), 0, 1)
            assert np.linalg.norm(q - p[a] - t * d) <= 1.0 + 1e-9


def test_trees_pay_and_small_fits():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 50, (600, 3))
    s = (x[:, 1] > 20).astype(int) * 5
    nodes = k.grow_tree(x, s, 4)
    assert nodes[0][:2] == (1, 20) and sum(n[2] for n in nodes if n[0] < 0) == 0
    curve = k.fit_strength(np.linspace(0, 1, 200), np.linspace(0, 3, 200), smooth=1e-6)
    assert np.abs(curve[:7] - np.linspace(0, 3, 7)).max() < 1e-2
    boxes = [(5, 9), (7, 3), (6, 6), (9, 2), (3, 3)]
    at = k.shelves(boxes, 16)
    for (a, b), (c, d) in itertools.combinations(zip(at, boxes), 2):
        assert a[0] + b[0] <= c[0] or c[0] + d[0] <= a[0] or a[1] + b[1] <= c[1] or c[1] + d[1] <= a[1]
    assert k.fraction(0.375) == (3, 8) and k.fraction(-1e12) == (-(2**31 - 1), 1) and k.fraction(3e9)[0] < 2**31
    codes, have = k.closed_loop(np.array([5, 400, -90]), 50)
    assert np.abs(have - [5, 400, -90]).max() <= 25 and (np.cumsum(codes) * 50 == have).all()
    counts = np.array([[90, 1, 0], [88, 3, 0], [0, 1, 95]]) * 10
    c = k.cluster_histograms(counts, 3)
    assert c[0] == c[1] != c[2]
    out = k.fill_invisible(np.array([[1, 9], [1, 9]]), np.array([[True, False], [True, True]]))
    assert out.tolist() == [[1, 1], [1, 9]]


def test_boxes_and_chains():
    assert k.merge_boxes([(0, 0, 2, 2), (5, 5, 6, 6), (2, 2, 5, 5), (9, 0, 9, 0)]) == [(0, 0, 6, 6), (9, 0, 9, 0)]
    v = np.zeros((5, 6), int)
    v[2, 1:5] = [9, 8, 7, 6]
    assert k.trace_chains(v, 5) == [[(1, 2), (2, 2), (3, 2), (4, 2)]]


def test_jpeg_files_decode_to_what_was_written():
    from mosaicq.sources import jpeg

    rng = np.random.default_rng(4)
    for n in (1, 2, 7):
        blocks = np.where(rng.random((n, 64)) < 0.2, rng.integers(-900, 900, (n, 64)), 0)
        blocks[0, 60:] = 0
        extra = jpeg.application(b"p" * 70000, b"camera", b"<xml/>")
        data = jpeg.write(blocks, 8, 8 * n, extra)
        assert (jpeg.coefficients(data)[1].reshape(-1, 64) == blocks).all()
        assert jpeg.kept(data) == {"icc": b"p" * 70000, "exif": b"camera", "xmp": b"<xml/>"}
    for broken in (data[:-40], b"no file", data[:30]):
        with pytest.raises(ValueError):
            jpeg.coefficients(broken)


def test_jpeg_reads_restarts_and_sampling():
    """A hand-made file: two components, the first with two blocks a unit, a restart after every unit; all codes one bit long or two."""
    from mosaicq.sources import jpeg

    one = lambda place, symbols: jpeg._segment(jpeg.DHT, bytes([place, 0, len(symbols)] + [0] * 14 + symbols))
    frame = jpeg._segment(jpeg.SOF0, bytes([8, 0, 8, 0, 32, 2, 1, 0x21, 0, 2, 0x11, 0]))
    scan = jpeg._segment(jpeg.SOS, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    # codes 00: size 0, 01: size 1; the other table 00: end of block. Units: +1, 0, -1 and then -1, -1, 0
    units = ["01" "1" "00" "00" "00" "01" "0" "00", "01" "0" "00" "01" "0" "00" "00" "00"]
    raw = [int(u + "1" * (-len(u) % 8), 2).to_bytes(-(-len(u) // 8), "big") for u in units]
    data = b"\xff\xd8" + jpeg._segment(jpeg.DRI, b"\x00\x01") + frame + one(0, [0, 1]) + one(16, [0, 1]) + scan + raw[0] + b"\xff\xd0" + raw[1] + b"\xff\xd9"
    got = jpeg.coefficients(data)
    assert got[1][:, :, 0].tolist() == [[1, 1, -1, -2]] and got[2][:, :, 0].tolist() == [[-1, 0]]


def test_bundles_come_apart_as_they_were_put_together():
    from mosaicq.sources import bundles

    whole = bundles.write(b"meta", b"image", b"profile", 3)
    assert bundles.read(whole) == {"version": 3, "metadata": b"meta", "profile": b"profile", "image": b"image"}
    for cut in (0, 2, 5, 9, 14):
        with pytest.raises(ValueError):
            bundles.read(whole[:cut])
    with pytest.raises(ValueError):
        bundles.write(b"m" * (1 << 16), b"")


def test_packing_restores_and_pays_for_repeats():
    text = list(b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabc" * 8)
    bits, tokens = k.packed_bits(text)
    assert k.lz_expand(tokens) == text and bits < 8 * len(text) / 10
    assert k.packed_bits([])[0] == 0 and k.packed_bits([7])[0] > 0


def test_clusters_are_no_worse_after_moves_and_merges():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 40, (10, 12)) * (rng.random((10, 12)) < 0.4)
    start = [int(x) for x in rng.integers(0, 4, 10)]
    done = k.refine_clusters(counts, start)
    assert k.cluster_bits(counts, done) <= k.cluster_bits(counts, start)
    best = min(k.cluster_bits(counts[:5], list(x)) for x in itertools.product(range(3), repeat=5))
    assert k.cluster_bits(counts[:5], k.refine_clusters(counts[:5], [0, 1, 2, 0, 1])) <= best * 1.05


def test_rounding_chains_match_all_choices():
    rng = np.random.default_rng(1)
    for _ in range(20):
        t = rng.random(7) * 9
        price = lambda d: np.log2(1 + np.abs(d))
        best = min(
            sum((v - q) ** 2 + 0.3 * price(q - p) for v, q, p in zip(t, own, (0, *own), strict=False))
            for own in itertools.product(*[(np.floor(v), np.floor(v) + 1) for v in t])
        )
        assert abs(k.cheapest_rounding(t, price, 0.3) - best) < 1e-9


def test_improved_paths_are_near_the_best():
    rng = np.random.default_rng(6)
    for _ in range(5):
        p = rng.random((8, 2))
        cost = np.sqrt(((p[:, None] - p[None, :]) ** 2).sum(axis=2))
        total, path = k.improved_path(cost)
        assert sorted(path) == list(range(8)) and total <= k.shortest_path(cost)[0] * 1.25


def test_trees_pay_for_the_best_predictor_and_prune():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 10, (400, 2))
    symbols = np.stack((np.where(x[:, 0] > 4, 3, rng.integers(0, 8, 400)), np.where(x[:, 0] > 4, rng.integers(0, 8, 400), 5)), axis=1)
    leaves = k.tree_leaves(k.grow_tree(x, symbols, 4))
    assert sum(t[2] for t in leaves) == 0  # each side has a predictor that leaves one symbol
    assert len(k.tree_leaves(k.grow_tree(x, symbols, 4, price=1e9))) == 1


def test_limited_counts_match_all_choices():
    rng = np.random.default_rng(5)
    for shift in (1, 2, 4):
        allowed = k.allowed_counts(shift, 6)
        assert allowed[0] == 0 and set(allowed) <= set(range(64)) and (shift > 3 or len(allowed) < 64)
        for _ in range(12):
            n = rng.integers(1, 400, 4).tolist()
            f, bits = k.limited_counts(n, shift, 6)
            top = max(range(4), key=lambda i: (n[i], -i))
            assert sum(f) == 64 and min(f) > 0 and all(f[i] in allowed for i in range(4) if i != top)
            others = [i for i in range(4) if i != top]
            best = min(
                sum(n[i] * np.log2(64 / x) for i, x in zip(others, own)) + n[top] * np.log2(64 / (64 - sum(own)))
                for own in itertools.product(allowed[1:], repeat=3) if sum(own) < 64
            )
            assert best - 1e-9 <= bits <= best * 1.02
    assert k.limited_counts([0, 0], 4) == ([0, 0], 0.0) and k.limited_counts([0, 9], 4)[0] == [0, 4096]
