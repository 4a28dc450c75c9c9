"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller substrings are sorted by
inducing, named, and the reduced text of names is sorted recursively; the full array is induced from it, once from
left to right and once from right to left. Inducing goes bucket by bucket, all suffixes of a bucket at a time. A
reduced text whose alphabet is no longer small, where buckets would hold a suffix or two each, is sorted by doubling
ranks instead.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024


def _spread(sa: np.ndarray, place: np.ndarray, symbols: np.ndarray, step: int, items: np.ndarray) -> None:
    """Put items, in order, at their buckets' next places, and move those places on."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    within = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    sa[place[ranked] + step * within] = items[order]
    place[ranked[first]] += step * np.diff(np.append(first, len(ranked)))


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the ``seeds``: leftmost-smaller suffixes in order."""
    n = len(text)
    sa = np.full(n, -1, np.int64)
    head = starts.copy()
    seed_symbol = text[seeds]
    seed_cut = np.searchsorted(seed_symbol, np.arange(len(starts) + 1))
    used = np.flatnonzero(ends > starts)
    for c in used:
        begin = starts[c]
        done = begin
        while done < head[c]:  # larger suffixes that start with c; those before one of them join the bucket at once
            batch = sa[done : head[c]]
            done = head[c]
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _spread(sa, head, text[before], 1, before)
        mine = seeds[seed_cut[c] : seed_cut[c + 1]]
        before = mine[mine > 0] - 1
        if len(before):
            _spread(sa, head, text[before], 1, before)
    tail = ends - 1
    larger_end = head  # larger suffixes fill their bucket up to here
    for c in used[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            batch = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _spread(sa, tail, text[before], -1, before)
        batch = sa[starts[c] : larger_end[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _spread(sa, tail, text[before], -1, before)
    return sa


def _doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling ranks."""
    n, span = len(text), 1
    rank = text.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1 if span < n else 0
        key = rank * (max(int(rank.max()), int(after.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        span *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of every suffix of a text of small non-negative integers, in order. The last symbol must be smaller
    than all others."""
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable") if n < 2 or text[0] != text[1] else np.arange(n)[::-1]
    size = int(text.max()) + 1
    if size > SMALL_ALPHABET:
        return _doubled(text)
    text = text.astype(np.uint16)
    differs = np.flatnonzero(text[1:] != text[:-1])
    next_differs = np.full(n, n - 1, np.int64)
    next_differs[: n - 1] = np.append(differs, n - 1)[np.searchsorted(differs, np.arange(n - 1))]
    at = next_differs[: n - 1]
    smaller = np.ones(n, bool)
    smaller[: n - 1] = text[at] < text[np.minimum(at + 1, n - 1)]
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=size))
    starts = ends - np.bincount(text, minlength=size)

    first = leftmost[np.argsort(text[leftmost], kind="stable")]
    sa = _induce(text, smaller, first, starts, ends)
    if (sa < 0).any():  # the last suffix is a seed: it was placed by its bucket alone
        sa[starts[text[n - 1]]] = n - 1
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ranked = sa[is_leftmost[sa]]
    name = np.zeros(n, np.int64)
    length = np.ones(n, np.int64)
    length[leftmost[:-1]] = np.diff(leftmost) + 1
    same = length[ranked[1:]] == length[ranked[:-1]]
    pairs = np.flatnonzero(same)
    live, k = pairs, 0
    while len(live):  # compare neighbours symbol by symbol, as long as they agree
        a, b = ranked[live], ranked[live + 1]
        agree = (text[a + k] == text[b + k]) & (smaller[a + k] == smaller[b + k])
        same[live[~agree]] = False
        live = live[agree]
        k += 1
        live = live[k < length[ranked[live]]]
    name[ranked] = np.concatenate([[0], np.cumsum(~same)])
    reduced = name[leftmost]
    if int(reduced.max()) + 1 < len(leftmost):
        order = suffix_array(reduced)
    else:
        order = np.argsort(reduced)
    sa = _induce(text, smaller, leftmost[order], starts, ends)
    if (sa < 0).any():
        sa[starts[text[n - 1]]] = n - 1
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix (by place in the text) shares with its predecessor in the array.

    Only suffixes that do not follow from the one to their left are compared; the others share one symbol less."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    fresh = np.ones(n, bool)
    inner = (place > 0) & (before > 0)
    fresh[inner] = text[place[inner] - 1] != text[before[inner] - 1]
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & (before >= 0))
    k = 0
    while len(live):
        a, b = live + k, before[live] + k
        ok = (a < n) & (b < n)
        ok[ok] = text[a[ok]] == text[b[ok]]
        shared[live[~ok]] = k
        live = live[ok]
        k += 1
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    out = shared[last] - (place - last)
    out[before < 0] = 0
    return np.maximum(out, 0)
