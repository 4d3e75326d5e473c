"""Suffix arrays by induced sorting and permuted common prefixes, in array operations.

Positions are classified as smaller (S) or larger (L) than their successor. The substrings between leftmost-S
positions are named in order; if names repeat, the string of names is sorted recursively. From the sorted
leftmost-S suffixes all others are induced: bucket by bucket, each scan places the predecessors of what it has
placed. Where the names of a deeper level are too many for scans by bucket, a suffix is placed by its symbols up
to the next leftmost-S suffix and that suffix's rank.
"""

from __future__ import annotations

import numpy as np

BUCKETS = 1024


def types_of(t: np.ndarray) -> np.ndarray:
    """True for S positions; the end counts as smaller than any symbol."""
    n = len(t)
    step = np.append(np.sign(np.diff(t)), -1)
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def ranks(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rank of each substring (the number of smaller ones) among substrings of which none is a proper prefix of another."""
    bits = int(symbols.max() + 1).bit_length()
    per, rank, step = max(1, 63 // bits), np.zeros(len(starts), np.int64), 0
    active = np.arange(len(starts))
    padded = np.append(symbols, -1)
    while len(active):
        word = np.zeros(len(active), np.int64)
        for k in range(step, step + per):
            at = np.where(k < lengths[active], np.minimum(starts[active] + k, len(symbols)), len(symbols))
            word = (word << bits) | (padded[at] + 1)
        order = np.lexsort((word, rank[active])) if step else np.argsort(word, kind="stable")
        members, word = active[order], word[order]
        group = rank[members]
        new_group = np.ones(len(order), bool)
        new_group[1:] = group[1:] != group[:-1]
        new = new_group.copy()
        new[1:] |= word[1:] != word[:-1]
        place = np.arange(len(order))
        rank[members] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
        step += per
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        alone = np.repeat(size == 1, size)
        active = members[~alone & (lengths[members] > step)]
        active.sort()
    return rank


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of numbers from 0 up."""
    n = len(t)
    is_s = types_of(t)
    left = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    symbols = 2 * t.astype(np.int64) + is_s
    ends = np.append(left[1:] + 1, n + 1)  # the next leftmost-S symbol belongs to a substring
    rank = ranks(symbols, left, ends - left)
    if not len(left) or len(np.unique(rank)) == len(left):
        order = np.argsort(rank)
    else:
        order = suffix_array(np.unique(rank, return_inverse=True)[1])
    if t.max() < BUCKETS:
        return induce(t, is_s, left[order])
    after = np.searchsorted(left, np.arange(n), "right")  # the next leftmost-S position behind each position
    stop = np.append(left, n)[after]
    left_rank = np.empty(len(left) + 1, np.int64)
    left_rank[order] = np.arange(len(left))
    left_rank[-1] = -1
    return np.lexsort((left_rank[after], ranks(symbols, np.arange(n), stop - np.arange(n) + 1)))


def induce(t: np.ndarray, is_s: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All suffixes in order from the sorted leftmost-S suffixes, by one scan up for L and one down for S."""
    n, k = len(t), int(t.max()) + 1
    kind = t.astype(np.uint16)
    counts = np.bincount(t, minlength=k)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = np.full(n, -1, np.int64)
    left_bounds = np.searchsorted(t[left], np.arange(k + 1))

    def place(found: np.ndarray, want_s: bool, free: np.ndarray, sign: int) -> None:
        before = found[found > 0] - 1
        before = before[is_s[before] == want_s]
        if not len(before):
            return
        symbol = kind[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        size = np.diff(np.append(first, len(symbol)))
        run = np.arange(len(symbol)) - np.repeat(first, size)
        sa[free[symbol] + sign * run] = before
        free[symbol[first]] += sign * size

    free = heads.copy()
    place(np.array([n]), False, free, 1)
    for c in range(k):
        at = heads[c]
        while at < free[c]:
            at, begin = free[c], at
            place(sa[begin:at], False, free, 1)
        if left_bounds[c] < left_bounds[c + 1]:
            place(left[left_bounds[c] : left_bounds[c + 1]], False, free, 1)
    ends_of_l = free.copy()
    free = tails - 1
    for c in range(k - 1, -1, -1):
        at = tails[c] - 1
        while at > free[c]:
            at, begin = free[c], at
            place(sa[at + 1 : begin + 1][::-1], True, free, -1)
        if heads[c] < ends_of_l[c]:
            place(sa[heads[c] : ends_of_l[c]][::-1], True, free, -1)
    return sa


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, how far its suffix agrees with the one before it in order. Only positions whose left
    neighbours differ are compared; behind them the length falls by one from each position to the next."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    own = np.ones(n, bool)
    own[1:] = (before[1:] <= 0) | (t[place[1:] - 1] != t[before[1:] - 1])
    length = np.zeros(n, np.int64)
    padded = np.append(t.astype(np.int32), np.full(32, -1, np.int32))
    padded[n:] = -1 - np.arange(32)
    active, step, width = np.flatnonzero(own & (before >= 0)), 0, 4
    while len(active):
        a, b = active + step, before[active] + step
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        span = np.arange(width)
        x, y = a[:, None] + span, b[:, None] + span
        same = (padded[np.minimum(x, n + 31)] == padded[np.minimum(y, n + 31)]) & (x < n) & (y < n)
        run = np.where(same.all(1), width, np.argmin(same, 1))
        length[active] += run
        active = active[run == width]
        step += width
        width = min(32, width * 2)
    at = np.maximum.accumulate(np.where(own, place, 0))
    return np.maximum(length[at] - (place - at), 0)
