"""Suffix arrays by two-stage sorting, to a bounded depth.

Stage one sorts the suffixes that are smaller than their successors directly, by their first DEPTH bytes. Stage two
scans the first-byte buckets from the least up: each suffix met puts its predecessor, if larger than it, at the
front of its own bucket. A bucket is scanned in waves, so that numpy moves many suffixes at a time. What is induced
is ordered one byte deeper than what induced it, so the result is in order to DEPTH bytes at least.
"""

from __future__ import annotations

import numpy as np

DEPTH = 56


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one; the last is larger than the empty suffix."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    last = np.full(n, n - 1)
    differs = np.flatnonzero(text[:-1] != text[1:])
    last[:-1] = n - 1
    at = np.searchsorted(differs, np.arange(n - 1))
    inside = at < len(differs)
    last[:-1][inside] = differs[at[inside]]  # the end of the run of equal bytes
    up = np.zeros(n, bool)
    more = last < n - 1
    up[more] = text[last[more]] < text[last[more] + 1]
    return up


def _with_inducers(small: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """wanted, with the suffixes between each of them and the next one that is sorted directly."""
    n = len(small)
    stop = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]  # the next sorted directly, or the end
    at = np.flatnonzero(wanted)
    steps = np.zeros(n + 2, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(stop[at], n) + 1, -1)
    return np.cumsum(steps)[:n] > 0


def words_at(text: np.ndarray, at: np.ndarray, n: int = DEPTH // 8) -> list[np.ndarray]:
    """The n big-endian 8-byte words from each position on; zeros follow the end."""
    padded = np.concatenate((text, np.zeros(8 * n, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return [np.ascontiguousarray(eight[at + 8 * k]).view(">u8").reshape(-1).astype(np.uint64) for k in range(n)]


def suffix_array(text: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of the suffixes of a uint8 array, in order to DEPTH bytes at least.

    wanted: a mask of the suffixes asked for; then only they and those that induce them are sorted and returned.
    """
    n = len(text)
    small = smaller_than_next(text)
    used = np.ones(n, bool) if wanted is None else _with_inducers(small, wanted)
    direct = np.flatnonzero(small & used)
    direct = direct[np.lexsort(words_at(text, direct)[::-1])]
    sizes = np.bincount(text[used], minlength=256)
    heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))  # where induced suffixes go next
    tails = heads + sizes
    order = np.full(sizes.sum(), -1, np.int64)
    ends = np.cumsum(np.bincount(text[direct], minlength=256))
    for c in range(256):  # sorted ones fill their bucket from the back
        k = ends[c] - (ends[c - 1] if c else 0)
        order[tails[c] - k : tails[c]] = direct[ends[c] - k : ends[c]]

    def induce(met: np.ndarray) -> None:
        before = met - 1
        before = before[before >= 0]
        before = before[~small[before] & used[before]]
        byte = text[before]
        rank = np.argsort(byte, kind="stable")
        counts = np.bincount(byte, minlength=256)
        shift = np.repeat(heads - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        order[shift + np.arange(len(before))] = before[rank]
        heads[:] += counts

    if n:
        induce(np.array([n]))  # the empty suffix comes first
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for c in range(256):
        done = start[c]
        while done < heads[c]:  # what this bucket has been given, and gives itself
            stop = heads[c]
            induce(order[done:stop])
            done = stop
        sorted_ones = order[heads[c] : tails[c]]
        if len(sorted_ones):
            induce(sorted_ones)
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix of `order` the bytes it shares with the one before it there, `most` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    open_, step = np.ones(len(order) - 1, bool), 0
    a, b = order[:-1], order[1:]
    padded = np.concatenate((text, np.zeros(most + 8, np.uint8)))
    rest = np.minimum(len(text) - a, len(text) - b)
    while step < most and open_.any():
        at = np.flatnonzero(open_)
        x = np.lib.stride_tricks.sliding_window_view(padded, 8)[a[at] + step]
        y = np.lib.stride_tricks.sliding_window_view(padded, 8)[b[at] + step]
        differs = x != y
        equal = np.where(differs.any(axis=1), differs.argmax(axis=1), 8)
        out[1:][at] += equal
        open_[at] = equal == 8
        step += 8
    out[1:] = np.minimum(out[1:], np.minimum(rest, most))
    return out
