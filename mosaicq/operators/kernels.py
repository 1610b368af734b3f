"""Sequential kernels: state runs from sample to sample, so each works on one image, stream or table at a time.

They are plain functions of arrays; mosaicq.plans.kernels applies them group by group, a group being an image's channel,
a stream or a small histogram of bounded size.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np

# Fixed values of the weighted predictor's presets: the four shares, and what each kind of error adds.
WP_PRESETS = (
    ((13, 12, 12, 12), (16, 10, 7, 7, 7, 0, 0)),
    ((13, 12, 12, 11), (8, 8, 4, 0, 3, 23, 2)),
    ((13, 12, 13, 12), (10, 9, 7, 0, 0, 16, 9)),
    ((13, 13, 12, 12), (16, 8, 0, 16, 0, 23, 0)),
)


_RECIPROCAL = np.array([0, *[(1 << 24) // n for n in range(1, 130)]])


def _bit_length(v: np.ndarray) -> np.ndarray:
    """Of whole numbers from 0 to 2**53."""
    return np.frexp(v.astype(np.float64))[1]


def _share(errors: np.ndarray, weight: int) -> np.ndarray:
    shift = np.maximum(0, _bit_length(errors + 1) - 6)
    return 4 + ((weight * _RECIPROCAL[(errors >> shift) + 1]) >> shift)


def weighted_residuals(plane: np.ndarray, own_shares: tuple = WP_PRESETS[0][0], p: tuple = WP_PRESETS[0][1]) -> np.ndarray:
    """What the self-correcting predictor leaves of a plane: four guesses are weighed by how far each was off nearby."""
    return weighted_residuals_of(plane, np.arange(len(plane)), own_shares, p)


def weighted_residuals_of(rows: np.ndarray, y_of: np.ndarray, own_shares: tuple = WP_PRESETS[0][0], p: tuple = WP_PRESETS[0][1]) -> np.ndarray:
    """The same for rows of many planes, one plane after the other, y_of counting a plane's rows from 0.

    A sample needs what lies left of it and, in the row above, up to the next column; so each row runs two samples behind the row above,
    and a step takes a sample of every row that has one then, of all planes. Rows are kept in order of y, so those are a slice."""
    many, cols = rows.shape
    order = np.argsort(y_of, kind="stable")
    y = y_of[order]
    at = np.empty(many, np.int64)
    at[order] = np.arange(many)
    above = at[np.maximum(order - 1, 0)]
    above[y == 0] = 0
    above2 = above[above]
    sample = np.ascontiguousarray(rows[order].T.astype(np.int64))  # (cols, many)
    flat = sample.reshape(-1)
    first = np.searchsorted(y, np.arange(int(y[-1]) + 2 if many else 1))  # where the rows of each y begin
    bound = lambda k: int(first[min(max(k, 0), len(first) - 1)])
    out = np.zeros((cols, many), np.int64)
    last_v, last_e = np.zeros(many, np.int64), np.zeros(many, np.int64)
    n_, ne_, nw_ = (np.zeros(many, np.int64) for _ in range(3))
    en_, ene_, enw_ = (np.zeros(many, np.int64) for _ in range(3))
    miss, far, here, back = (np.zeros((4, many), np.int64) for _ in range(4))  # a row's own last misses; what the row above was off at x + 1, x and x - 1
    for t in range(-1, cols + 2 * int(y[-1]) if many else 0):
        # rows from x = -1, where the first sample above comes into sight, to the last column
        lo, mid, hi = bound(-(-(t - cols + 1) // 2)), bound(-(-(t - cols + 2) // 2)), bound((t + 1) // 2 + 1)
        lo = max(lo, bound(1))
        mid = max(mid, lo)
        if lo < hi:
            s, g, e = slice(lo, hi), slice(mid, hi), slice(lo, mid)
            back[:, s] = here[:, s]
            here[:, s] = far[:, s] + miss[:, s]
            nw_[s], n_[s], enw_[s], en_[s] = n_[s], ne_[s], en_[s], ene_[s]
            up = above[g]
            far[:, g], ne_[g], ene_[g] = miss[:, up], last_v[up], last_e[up]
            far[:, e], ne_[e], ene_[e] = here[:, e], n_[e], en_[e]
        a, b = bound(-(-(t - cols + 1) // 2)), bound(t // 2 + 1)
        if t < 0 or a >= b:
            continue
        s = slice(a, b)
        own_y = y[s]
        x = t - 2 * own_y
        place = x * many + np.arange(a, b)
        v, top = flat[place], own_y == 0
        w, e_w = np.where(x == 0, np.where(top, 0, n_[s]), last_v[s]), np.where(x == 0, 0, last_e[s])
        n, ne, nw = n_[s], ne_[s], np.where(x == 0, n_[s], nw_[s])
        e_n, e_ne, e_nw = en_[s], ene_[s], np.where(x == 0, en_[s], enw_[s])
        if a < bound(1):
            n, ne, nw = np.where(top, w, n), np.where(top, w, ne), np.where(top, w, nw)
        nn = np.where(own_y > 1, flat[x * many + above2[s]], n)
        w8, n8, nw8, ne8, nn8 = (q * 8 for q in (w, n, nw, ne, nn))
        guesses = (
            w8 + ne8 - n8,
            n8 - ((e_n + e_w + e_ne) * p[0] >> 5),
            w8 - ((e_n + e_w + e_nw) * p[1] >> 5),
            n8 - ((e_nw * p[2] + e_n * p[3] + e_ne * p[4] + (nn8 - n8) * p[5] + (nw8 - w8) * p[6]) >> 5),
        )
        near = here[:, s] + far[:, s] + np.where(x == 0, here[:, s], back[:, s])
        shares = [_share(near[k], own_shares[k]) for k in range(4)]
        shift = _bit_length(shares[0] + shares[1] + shares[2] + shares[3]) - 5
        shares = [share >> shift for share in shares]
        total = shares[0] + shares[1] + shares[2] + shares[3]
        guess = (sum(share * g for share, g in zip(shares, guesses, strict=True)) + (total >> 1) - 1) * _RECIPROCAL[total] >> 24
        held = np.minimum(np.maximum(guess, np.minimum(np.minimum(w8, ne8), n8)), np.maximum(np.maximum(w8, ne8), n8))
        guess = np.where(((e_n ^ e_w) | (e_n ^ e_nw)) <= 0, held, guess)
        out.reshape(-1)[place] = v - ((guess + 3) >> 3)
        last_v[s], last_e[s] = v, guess - v * 8
        for k in range(4):
            miss[k, s] = (np.abs(guesses[k] - v * 8) + 3) >> 3
    whole = np.empty((many, cols), np.int64)
    whole[order] = out.T
    return whole


def tendency(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The slope that squeeze expects in a pair, from the averages around it."""
    falls, rises = (left >= middle) & (middle >= right), (left <= middle) & (middle <= right)
    sign = np.where(falls, 1, -1)
    left, middle, right = sign * left, sign * middle, sign * right
    d = (4 * left - 3 * right - middle + 6) // 12
    d = np.where(d - (d & 1) > 2 * (left - middle), 2 * (left - middle) + 1, d)
    d = np.where(d + (d & 1) > 2 * (middle - right), 2 * (middle - right), d)
    return np.where(falls | rises, sign * d, 0)


def squeeze(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Averages and residuals of a row's pairs, or of many rows' along the last axis; a last sample without partner is its own average."""
    row = np.asarray(row, np.int64)
    n = row.shape[-1]
    a, b = row[..., 0 : n - n % 2 : 2], row[..., 1::2]
    avg = (a + b + (a > b)) >> 1
    if n % 2:
        avg = np.concatenate((avg, row[..., -1:]), axis=-1)
    pairs = a.shape[-1]
    left = np.concatenate((avg[..., :1], b), axis=-1)[..., :pairs]
    right = np.concatenate((avg[..., 1:], avg[..., -1:]), axis=-1)[..., :pairs]
    return avg, a - b - tendency(left, avg[..., :pairs], right)


def unsqueeze(avg: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """The rows again: each pair needs the sample just restored."""
    pairs = diff.shape[-1]
    out = np.empty((*avg.shape[:-1], avg.shape[-1] + pairs), np.int64)
    for k in range(pairs):
        left = out[..., 2 * k - 1] if k else avg[..., 0]
        right = avg[..., min(k + 1, avg.shape[-1] - 1)]
        whole = diff[..., k] + tendency(left, avg[..., k], right)
        out[..., 2 * k] = avg[..., k] + (whole + (whole < 0)) // 2
        out[..., 2 * k + 1] = out[..., 2 * k] - whole
    out[..., 2 * pairs :] = avg[..., pairs:]
    return out


def huffman_depths(counts: list[int], limit: int = 15) -> list[int]:
    """Code lengths of at most `limit` bits; too deep a tree is built again with its rarest symbols counted higher."""
    used = [k for k, n in enumerate(counts) if n]
    if len(used) < 2:
        return [int(bool(n)) for n in counts]
    floor = 1
    while True:
        heap = [(max(counts[k], floor), i, (k,)) for i, k in enumerate(reversed(used))]
        heapq.heapify(heap)
        depths, serial = [0] * len(counts), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for k in a[2] + b[2]:
                depths[k] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
            serial += 1
        if max(depths) <= limit:
            return depths
        floor *= 2


def ans_counts(counts: list[int], table: int = 4096) -> list[int]:
    """Counts scaled to a table: none vanishes, what is missing goes to the first maximum, what is too much comes off the maxima."""
    total = sum(counts)
    out = [0 if not n else max(1, n * table // total) for n in counts]
    rest = table - sum(out)
    if rest > 0:
        out[out.index(max(out))] += rest
    for _ in range(-rest):
        out[out.index(max(out))] -= 1
    return out


def allowed_counts(shift: int, bits: int = 12) -> np.ndarray:
    """The counts that a table of 2**bits can tell at this precision: of each magnitude only so many leading bits may be set."""
    out = {0}
    for n in range(1, 1 << bits):
        log = n.bit_length() - 1
        kept = max(0, min(log, shift - ((bits - log) >> 1)))
        if n & ((1 << (log - kept)) - 1) == 0:
            out.add(n)
    return np.array(sorted(out))


def limited_counts(counts: list[int], shift: int, bits: int = 12) -> tuple[list[int], float]:
    """Counts scaled to 2**bits of which all but the largest are allowed at a precision, and the data's bits under them.

    The largest takes what the others leave. They start at the allowed count nearest to their share; then the step of one of them to
    a neighbouring count that saves most is taken, for as long as one saves anything."""
    table, allowed = 1 << bits, allowed_counts(shift, bits)
    used = [k for k, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if not used:
        return out, 0.0
    total, top = sum(counts), max(used, key=lambda k: (counts[k], -k))
    others = [k for k in used if k != top]
    places = allowed[1:]
    at = {k: int(np.abs(places - counts[k] * table / total).argmin()) for k in others}
    while sum(places[i] for i in at.values()) >= table:  # the smallest leave it at the least
        k = max(at, key=lambda k: (places[at[k]], -k))
        at[k] -= 1

    def cost() -> float:
        rest = table - sum(int(places[i]) for i in at.values())
        return sum(counts[k] * np.log2(table / places[i]) for k, i in at.items()) + counts[top] * np.log2(table / rest)

    best = cost()
    while True:
        found = (best - 1e-9, -1, 0)
        for k in others:
            for step in (-1, 1):
                if 0 <= at[k] + step < len(places) and sum(int(places[i]) for i in at.values()) - places[at[k]] + places[at[k] + step] < table:
                    at[k] += step
                    found = min(found, (cost(), k, step))
                    at[k] -= step
        if found[1] < 0:
            break
        best = found[0]
        at[found[1]] += found[2]
    for k, i in at.items():
        out[k] = int(places[i])
    out[top] = table - sum(out)
    return out, float(best)


def rans_encode(symbols: list[int], freq: list[int], bits: int = 12) -> tuple[int, list[int]]:
    """A range-coded stream: final state and 16-bit words, from the last symbol to the first."""
    start = np.cumsum([0, *freq]).tolist()
    state, words = 1 << 16, []
    for s in reversed(symbols):
        if state >= freq[s] << (32 - bits):
            words.append(state & 0xFFFF)
            state >>= 16
        state = (state // freq[s] << bits) + state % freq[s] + start[s]
    return state, words


def rans_decode(state: int, words: list[int], n: int, freq: list[int], bits: int = 12) -> list[int]:
    start = np.cumsum([0, *freq]).tolist()
    of = np.repeat(np.arange(len(freq)), freq).tolist()  # each slot's symbol
    out, words, mask = [], list(words), (1 << bits) - 1
    for _ in range(n):
        slot = state & mask
        s = of[slot]
        state = freq[s] * (state >> bits) + slot - start[s]
        if state < 65536 and words:
            state = state << 16 | words.pop()
        out.append(s)
    return out


def _sliceable(values: list[int]) -> bytes | tuple:
    """The values so that slices are fast to compare."""
    return bytes(values) if not len(values) or (0 <= min(values) and max(values) < 256) else tuple(values)


def _before(v: bytes | tuple, n: int) -> list[int]:
    """For each place the latest one before it with the same n values from there on, or -1."""
    code = np.frombuffer(v, np.uint8).astype(np.int64) if isinstance(v, bytes) else np.unique(np.array(v), return_inverse=True)[1].reshape(-1)
    key = code[: max(0, len(v) - n + 1)]
    for k in range(1, n):
        key = key * (int(code.max(initial=0)) + 1) + code[k : k + len(key)]
        if not isinstance(v, bytes):
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    out = np.full(len(v), -1)
    out[order[1:][again]] = order[:-1][again]
    return out.tolist()


def _match(v: bytes | tuple, place: int, at: int, k: int) -> int:
    """How many values from place on equal those from at on, of which k are known to."""
    n = len(v) - at
    near = min(n, k + 16)
    while k < near:
        if v[place + k] != v[at + k]:
            return k
        k += 1
    size = 16
    while k + size <= n and v[place + k : place + k + size] == v[at + k : at + k + size]:
        k += size
        size *= 2
    while size > 1:
        size //= 2
        if k + size <= n and v[place + k : place + k + size] == v[at + k : at + k + size]:
            k += size
    return k


def lz_parse(values: list[int], least: int = 3, probes: int = 16) -> list[tuple[int, int, int]]:
    """(value, length, distance) tokens: a greedy parse over a ring of the latest places of each four values; longer wins,
    then nearer. Literals have length 0."""
    v = _sliceable(values)
    before = _before(v, 4)
    out, at, n = [], 0, len(v)
    least = max(least, 4)
    while at < n:
        place = before[at]
        if place < 0:
            out.append((v[at], 0, 0))
            at += 1
            continue
        best = distance = tried = 0
        while place >= 0 and tried < probes:
            if not best:
                best, distance = _match(v, place, at, 4), at - place
            elif at + best >= n:
                break
            elif v[place + best] == v[at + best] and v[place : place + best] == v[at : at + best]:
                best, distance = _match(v, place, at, best + 1), at - place
            place = before[place]
            tried += 1
        if best >= least:
            out.append((0, best, distance))
            at += best
        else:
            out.append((v[at], 0, 0))
            at += 1
    return out


def lz_expand(tokens: list[tuple[int, int, int]]) -> list[int]:
    out: list[int] = []
    for value, length, distance in tokens:
        if length:
            for _ in range(length):
                out.append(out[-distance])
        else:
            out.append(value)
    return out


def copy_price(length: int, distance: int) -> float:
    """Bits of a copy: its flag, and as many for length and distance as their magnitudes ask for."""
    return 4.0 + 2 * max(length - 3, 0).bit_length() + 1.5 * distance.bit_length()


def priced_parse(values: list[int], price: dict[int, float], least: int = 3, probes: int = 8) -> float:
    """Bits of the cheapest parse: dynamic programming over literals and, at each place, every length of its latest matches."""
    v = _sliceable(values)
    before, n = _before(v, least), len(v)
    cost = [0.0] + [float("inf")] * n
    for at, x in enumerate(values):
        here = cost[at]
        if here + price[x] < cost[at + 1]:
            cost[at + 1] = here + price[x]
        place, done, tried = before[at], least - 1, 0
        while place >= 0 and tried < probes and at + done < n:  # the nearer come first, so a farther one serves lengths beyond theirs alone
            if v[place + done] == v[at + done] and v[place : place + done] == v[at : at + done]:
                k = _match(v, place, at, done + 1)
                for length in range(done + 1, k + 1):
                    total = here + copy_price(length, at - place)
                    if total < cost[at + length]:
                        cost[at + length] = total
                done = k
            place = before[place]
            tried += 1
    return cost[n]


def components8(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected components, by their first pixel in raster order; -1 outside the mask."""
    rows, cols = mask.shape
    parent = np.arange(rows * cols)

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for y, x in zip(*np.nonzero(mask), strict=True):
        for dy, dx in ((0, -1), (-1, -1), (-1, 0), (-1, 1)):
            v, u = y + dy, x + dx
            if 0 <= v and 0 <= u < cols and mask[v, u]:
                a, b = find(y * cols + x), find(v * cols + u)
                parent[max(a, b)] = min(a, b)
    out = np.full(rows * cols, -1)
    for k in np.flatnonzero(mask.reshape(-1)):
        out[k] = find(int(k))
    return out.reshape(mask.shape)


def largest_rectangle(free: np.ndarray) -> tuple[int, int, int, int]:
    """x0, y0, width, height of the largest free rectangle: a stack of bars per row; the first found wins ties."""
    best = (0, 0, 0, 0)
    height = np.zeros(free.shape[1], np.int64)
    for y, row in enumerate(free):
        height = np.where(row, height + 1, 0)
        stack: list[tuple[int, int]] = []
        for x, h in enumerate([*height.tolist(), 0]):
            first = x
            while stack and stack[-1][1] >= h:
                first, tall = stack.pop()
                if tall * (x - first) > best[2] * best[3]:
                    best = (first, y - tall + 1, x - first, tall)
            stack.append((first, h))
    return best


def simplify(points: np.ndarray, tolerance: float) -> list[int]:
    """Indices of a polyline's points that keep it within a tolerance: split where it bends away most."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a], points[b] - points[a]
        length = float(d @ d) or 1.0
        t = np.clip(((points[a + 1 : b] - p) @ d) / length, 0, 1)
        far = ((points[a + 1 : b] - p - t[:, None] * d) ** 2).sum(axis=1)
        k = int(far.argmax())
        if far[k] > tolerance**2:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)


def shortest_path(cost: np.ndarray) -> tuple[float, list[int]]:
    """The cheapest open path through all points, exactly: dynamic programming over subsets (few points)."""
    n = len(cost)
    best = {(1 << k, k): (0.0, -1) for k in range(n)}
    for size in range(1, n):
        for subset in (s for s in range(1 << n) if s.bit_count() == size):
            for last in (k for k in range(n) if subset >> k & 1):
                c = best[subset, last][0]
                for k in (k for k in range(n) if not subset >> k & 1):
                    key, new = (subset | 1 << k, k), c + cost[last, k]
                    if key not in best or new < best[key][0]:
                        best[key] = (new, last)
    full = (1 << n) - 1
    last = min(range(n), key=lambda k: (best[full, k][0], k))
    total, path, subset = best[full, last][0], [], full
    while last >= 0:
        path.append(last)
        subset, last = subset ^ 1 << last, best[subset, last][1]
    return total, path[::-1]


def improved_path(cost: np.ndarray) -> tuple[float, list[int]]:
    """An open path through many points: always on to the nearest, then stretches turned round for as long as that shortens it."""
    n = len(cost)
    path, left = [0], set(range(1, n))
    while left:
        path.append(min(left, key=lambda k: (cost[path[-1], k], k)))
        left.remove(path[-1])
    better = True
    while better:
        better = False
        for a in range(n - 1):
            for b in range(a + 1, n):
                before = (cost[path[a - 1], path[a]] if a else 0.0) + (cost[path[b], path[b + 1]] if b + 1 < n else 0.0)
                after = (cost[path[a - 1], path[b]] if a else 0.0) + (cost[path[a], path[b + 1]] if b + 1 < n else 0.0)
                if after < before - 1e-9:
                    path[a : b + 1], better = path[a : b + 1][::-1], True
    return float(sum(cost[x, y] for x, y in zip(path, path[1:]))), path


def best_levels(values: np.ndarray, weights: np.ndarray, k: int) -> tuple[float, list[float]]:
    """k levels of least weighted squared error for sorted values: each level serves a run of them."""
    n = len(values)
    k = min(k, n)
    w, wx, wxx = (np.concatenate(([0.0], np.cumsum(weights * values**p))) for p in (0, 1, 2))

    def error(a: np.ndarray, b: int) -> np.ndarray:
        return wxx[b] - wxx[a] - (wx[b] - wx[a]) ** 2 / np.maximum(w[b] - w[a], 1e-300)

    cost = np.array([0.0] + [float(error(np.array([0]), b)[0]) for b in range(1, n + 1)])
    cuts = [np.zeros(n + 1, np.int64)]
    for level in range(1, k):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for b in range(level + 1, n + 1):
            a = np.arange(level, b)
            total = cost[a] + error(a, b)
            new[b], cut[b] = total.min(), a[total.argmin()]
        cost = new
        cuts.append(cut)
    b, levels = n, []
    for cut in reversed(cuts):
        a = int(cut[b])
        levels.append(float((wx[b] - wx[a]) / (w[b] - w[a])))
        b = a
    return max(0.0, float(cost[n])), levels[::-1]


def trellis(values: np.ndarray, rate: float) -> list[int]:
    """Integers for scaled coefficients that cost least in error and bits: a zero after a zero is cheap, so runs are kept."""
    states = {True: (0.0, []), False: (float("inf"), [])}  # whether the last one was zero
    for v in values.tolist():
        nearest = round(v)
        options = {0, nearest, nearest - (1 if nearest > 0 else -1 if nearest < 0 else 0)}
        new = {}
        for q in sorted(options, key=abs):
            for zero, (cost, path) in states.items():
                bits = (0.3 if zero else 1.0) if q == 0 else 2.5 + 2 * np.log2(abs(q)) + (1.0 if zero else 0.0)
                total = cost + (v - q) ** 2 + rate * bits
                if total < new.get(q == 0, (float("inf"),))[0]:
                    new[q == 0] = (total, [*path, q])
        states = {z: new.get(z, (float("inf"), [])) for z in (True, False)}
    return min(states.values(), key=lambda s: s[0])[1]


def grow_tree(x: np.ndarray, symbol: np.ndarray, leaves: int, least: int = 32, price: float = 0.0) -> list[tuple]:
    """Nodes (property, threshold, gain or bits, above, below) grown best gain first; a leaf's property is -1.

    symbol has a column for each predictor, and a leaf pays for its best one. Splits that gain less than `price` are pruned, the last first."""
    symbol = symbol.reshape(len(symbol), -1)
    predictors, n_all = symbol.shape[1], len(symbol)
    alphabet, code = np.unique(symbol, return_inverse=True)
    size, code = max(1, len(alphabet)), code.reshape(symbol.shape)
    code = code + np.arange(predictors) * size
    levels = [np.unique(column, return_inverse=True) for column in x.T]
    rank = np.stack([r.reshape(-1) for _, r in levels], axis=1) if levels else np.zeros((n_all, 0), np.int64)
    count = np.arange(1, n_all + 1)
    entropy = np.concatenate(([0.0], count * np.log2(count)))  # n log2 n
    step = max(1, (1 << 22) // max(1, rank.shape[1] * predictors))

    def bits(rows: np.ndarray) -> float:
        n = np.bincount(code[rows].reshape(-1), minlength=predictors * size).reshape(predictors, size)
        return float(entropy[len(rows)] - entropy[n].sum(axis=1).max()) if len(rows) else 0.0

    def split(rows: np.ndarray) -> tuple[float, int, int]:
        """Of all properties and up to some 60 thresholds of each, at once: rows are counted between thresholds, and summed up to each."""
        place, tests, slots = [], [], 0
        for p, (value, _) in enumerate(levels):
            here = np.flatnonzero(np.bincount(rank[rows, p], minlength=len(value)))[:-1]
            here = here[:: max(1, len(here) // 32)]
            over = np.zeros(len(value) + 1, np.int64)
            over[here + 1] = 1
            place.append(slots + np.cumsum(over)[:-1])  # how many thresholds a value is above, counted on from the properties before
            tests += [(p, int(value[h])) for h in here.tolist()]
            slots += len(here) + 1
        if not tests or len(rows) < 2 * least:
            return 0.0, -1, 0
        counts = np.zeros(slots * predictors * size, np.int64)
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            slot = np.stack([place[p][rank[part, p]] for p in range(len(levels))], axis=1)
            counts += np.bincount((slot[:, :, None] * (predictors * size) + code[part][:, None, :]).reshape(-1), minlength=len(counts))
        counts = counts.reshape(slots, predictors, size)
        total = counts[: int(place[1][0]) if len(place) > 1 else slots].sum(axis=0)
        of = np.array([p for p, _ in tests])
        below = np.cumsum(counts, axis=0)[np.arange(len(tests)) + of] - of[:, None, None] * total
        fewer = below[:, 0].sum(axis=1)
        fits = np.flatnonzero((fewer >= least) & (len(rows) - fewer >= least))
        below, fewer = below[fits], fewer[fits]
        under = (entropy[fewer][:, None] - entropy[below].sum(axis=2)).min(axis=1)
        above = (entropy[len(rows) - fewer][:, None] - entropy[total - below].sum(axis=2)).min(axis=1)
        best = (0.0, -1, 0)
        for gain, k in zip((bits(rows) - above - under).tolist(), fits.tolist(), strict=True):
            if gain > best[0] + 1e-9:
                best = (gain, *tests[k])
        return best

    nodes: list[tuple] = [(-1, 0, bits(np.arange(n_all)), -1, -1)]
    own = [nodes[0][2]]
    rows_of = {0: np.arange(len(symbol))}
    first = split(rows_of[0])
    heap = [(-first[0], 0, first)]
    while heap and len(rows_of) < leaves:
        gain, k, (_, p, t) = heapq.heappop(heap)
        if gain >= 0:
            break
        rows = rows_of.pop(k)
        above = x[rows, p] > t
        nodes[k] = (p, t, -gain, len(nodes), len(nodes) + 1)
        for part in (rows[above], rows[~above]):
            rows_of[len(nodes)] = part
            found = split(part)
            heapq.heappush(heap, (-found[0], len(nodes), found))
            nodes.append((-1, 0, bits(part), -1, -1))
            own.append(nodes[-1][2])
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
        p, _, gain, a, b = nodes[k]
        if p >= 0 and nodes[a][0] < 0 and nodes[b][0] < 0 and gain < price:
            nodes[k] = (-1, 0, own[k], -1, -1)
    return nodes


def tree_leaves(nodes: list[tuple]) -> list[tuple]:
    """The leaves that the root reaches."""
    out, todo = [], [0]
    while todo:
        node = nodes[todo.pop()]
        if node[0] < 0:
            out.append(node)
        else:
            todo += [node[3], node[4]]
    return out


def _entropy_bits(n: np.ndarray) -> float:
    n = n[n > 0]
    return float(n.sum() * np.log2(n.sum()) - (n * np.log2(n)).sum()) if len(n) > 1 else 0.0


def cluster_bits(counts: np.ndarray, of: list[int], header: float = 64.0) -> float:
    """What the clusters' histograms and headers take."""
    return sum(_entropy_bits(counts[[k for k, c in enumerate(of) if c == own]].sum(axis=0)) + header for own in set(of))


def cluster_histograms(counts: np.ndarray, most: int, header: float = 64.0) -> list[int]:
    """A cluster for each histogram: seeds are what the others code worst, then each goes to the seed that costs it least; then
    histograms move and clusters merge for as long as either makes the whole smaller."""
    own = [_entropy_bits(c) for c in counts]
    apart = lambda a, b: _entropy_bits(counts[a] + counts[b]) - own[a] - own[b]
    seeds = [int(counts.sum(axis=1).argmax())]
    near = [apart(seeds[0], k) for k in range(len(counts))]
    while len(seeds) < most:
        k = int(np.argmax(near))
        if near[k] <= header:
            break
        seeds.append(k)
        near = [min(d, apart(k, j)) for j, d in enumerate(near)]
    of = [min(range(len(seeds)), key=lambda s: (apart(seeds[s], k) if seeds[s] != k else -1.0, s)) for k in range(len(counts))]
    return refine_clusters(counts, of, header)


def refine_clusters(counts: np.ndarray, of: list[int], header: float = 64.0) -> list[int]:
    """The same clusters after all moves of one histogram, and merges of two clusters, that make the whole smaller; numbered by first use."""
    of, best = list(of), cluster_bits(counts, of, header)
    while True:
        moves = [[*of[:k], c, *of[k + 1 :]] for k in range(len(of)) for c in sorted(set(of)) if c != of[k]]
        merges = [[a if c == b else c for c in of] for a in sorted(set(of)) for b in sorted(set(of)) if a < b]
        cost, _, other = min(((cluster_bits(counts, x, header), i, x) for i, x in enumerate(moves + merges)), default=(best, 0, of))
        if cost >= best - 1e-9:
            names: dict[int, int] = {}
            return [names.setdefault(c, len(names)) for c in of]
        of, best = other, cost


def fit_strength(intensity: np.ndarray, level: np.ndarray, points: int = 8, smooth: float = 0.1) -> np.ndarray:
    """A piecewise-linear curve through samples by least squares with a pull toward smoothness."""
    at = np.clip(intensity * (points - 2), 0, points - 1 - 1e-9)
    k, f = at.astype(int), at - at.astype(int)
    a = np.zeros((len(at), points))
    a[np.arange(len(at)), k], a[np.arange(len(at)), k + 1] = 1 - f, f
    d = smooth * np.diff(np.eye(points), axis=0)
    return np.linalg.solve(a.T @ a + d.T @ d + 1e-9 * np.eye(points), a.T @ level)


def shelves(sizes: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Places (x, y) for boxes (w, h) on shelves, the tallest first."""
    places = [(0, 0)] * len(sizes)
    x = y = tall = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k][1], -sizes[k][0], k)):
        w, h = sizes[k]
        if x + w > width:
            x, y, tall = 0, y + tall, 0
        places[k] = (x, y)
        x, tall = x + w, max(tall, h)
    return places


def fraction(v: float, numerator: int = (1 << 31) - 1, denominator: int = (1 << 32) - 1) -> tuple[int, int]:
    """The nearest signed numerator and denominator that fit 32 bits."""
    most = min(denominator, int(numerator / abs(v))) if abs(v) > 1 else denominator
    f = Fraction(v).limit_denominator(max(1, most))
    return max(-numerator, min(numerator, f.numerator)), f.denominator


def fill_invisible(plane: np.ndarray, visible: np.ndarray) -> np.ndarray:
    """Invisible samples take what the samples before them predict, in raster order."""
    out = plane.copy()
    for y in range(len(out)):
        for x in range(out.shape[1]):
            if not visible[y, x]:
                w = out[y, x - 1] if x else out[y - 1, x] if y else 0
                n = out[y - 1, x] if y else w
                nw = out[y - 1, x - 1] if x and y else w
                out[y, x] = min(max(w + n - nw, min(w, n)), max(w, n))
    return out


def closed_loop(values: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised residuals against what a decoder will have, and what it will have."""
    codes, have, before = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64), 0
    for k, v in enumerate(values.tolist()):
        d = v - before
        q = (abs(d) + step // 2) // step * (1 if d >= 0 else -1)
        before += q * step
        codes[k], have[k] = q, before
    return codes, have


def grown(mask: np.ndarray) -> np.ndarray:
    """mask and all that touches it, corners included."""
    wide = np.pad(mask, 1)
    return np.any([wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)


def shrunk(mask: np.ndarray) -> np.ndarray:
    """What of mask touches nothing outside it; beyond the edge counts as inside."""
    return ~grown(~mask)


def merge_boxes(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1), ends included, joined until none overlap; in order."""
    out: list[tuple[int, int, int, int]] = []
    for box in boxes:
        while True:
            hit = next((b for b in out if b[0] <= box[2] and box[0] <= b[2] and b[1] <= box[3] and box[1] <= b[3]), None)
            if hit is None:
                break
            out.remove(hit)
            box = (min(box[0], hit[0]), min(box[1], hit[1]), max(box[2], hit[2]), max(box[3], hit[3]))
        out.append(box)
    return sorted(out)


def trace_chains(strength: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """Chains of 8-neighbours of at least a strength: from the strongest free pixel on, always to the strongest free neighbour."""
    free = strength >= least
    rows, cols = strength.shape
    chains = []
    for at in np.argsort(-strength, axis=None, kind="stable").tolist():
        y, x = divmod(at, cols)
        if not free[y, x]:
            continue
        chain = []
        while True:
            free[y, x] = False
            chain.append((x, y))
            near = [(-int(strength[v, u]), v, u) for v in range(max(0, y - 1), min(rows, y + 2)) for u in range(max(0, x - 1), min(cols, x + 2)) if free[v, u]]
            if not near:
                break
            _, y, x = min(near)
        chains.append(chain)
    return chains


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Values of so many bits each, the lowest bit first, padded to a byte with zeros."""
    each = (values.astype(np.int64)[:, None] >> np.arange(bits)) & 1
    return np.packbits(each.reshape(-1).astype(np.uint8), bitorder="little").tobytes()


def cheapest_rounding(t: np.ndarray, price, rate: float) -> float:
    """Least cost of a chain that rounds each value down or up: squared errors, and rate times the price of each step; it starts from 0."""
    return float(cheapest_roundings(t, np.zeros(1, np.int64), price, rate)[0])


def cheapest_roundings(t: np.ndarray, starts: np.ndarray, price, rate: float) -> np.ndarray:
    """The same of many chains, one after the other in t: a step takes the next value of every chain that has one."""
    length = np.diff(starts, append=len(t))
    order = np.argsort(-length, kind="stable")
    first, having = starts[order], np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
    down, up = np.zeros(len(starts)), np.zeros(len(starts))
    q = np.zeros(len(starts))
    for k, m in enumerate(having.tolist()):  # m chains are longer than k
        v = t[first[:m] + k]
        low, before = np.floor(v), q[:m]
        if k:
            to_low = np.minimum(down[:m] + rate * price(low - before), up[:m] + rate * price(low - (before + 1)))
            to_high = np.minimum(down[:m] + rate * price(low + 1 - before), up[:m] + rate * price(low + 1 - (before + 1)))
        else:
            to_low, to_high = rate * price(low), rate * price(low + 1)
        down[:m], up[:m], q[:m] = (v - low) ** 2 + to_low, (v - (low + 1)) ** 2 + to_high, low
    cost = np.empty(len(starts))
    cost[order] = np.minimum(down, up)
    return cost


def packed_bits(values: list[int]) -> tuple[int, list[tuple[int, int, int]]]:
    """Bits of a byte string under a greedy parse whose literals, lengths and distances have a prefix code each, and the parse.

    Lengths and distances are coded by magnitude with their lower bits as they are; a code's table takes five bits a symbol."""
    tokens = lz_parse(values)
    literals = [v for v, n, _ in tokens if not n]
    lengths, distances = [n for _, n, _ in tokens if n], [d for _, n, d in tokens if n]
    total = 0
    for symbols, raw in ((literals, 0), ([n.bit_length() for n in lengths], sum(n.bit_length() - 1 for n in lengths)), ([d.bit_length() for d in distances], sum(d.bit_length() - 1 for d in distances))):
        n = np.bincount(symbols, minlength=1).tolist()
        total += sum(a * b for a, b in zip(n, huffman_depths(n), strict=True)) + raw + 5 * sum(x > 0 for x in n)
    return total + len(tokens), tokens
