"""Which windows of a text repeat, from its Burrows-Wheeler transform.

Intervals of the suffix array are extended backwards, one symbol a level,
breadth first.  The level at which an interval's end is first met is the length
of the common prefix there, so common prefixes come by increasing value; at the
threshold the walk stops, and ends that were never met have longer ones.
"""

from __future__ import annotations

import numpy as np

#: Stands between strings; no byte of UTF-8 has this value.
SEPARATOR = 0xFF


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes or more."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    order = np.argsort(key)
    length = 8
    while True:
        ordered = key[order]
        fresh = np.empty(n, bool)
        fresh[0] = False
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64)
        if length >= depth or (n > 1 and fresh[1:].all()):
            return order
        follow = np.zeros(n, np.uint64)
        follow[: n - length] = rank[length:] + np.uint64(1)
        key = (rank << np.uint64(32)) | follow
        order = np.argsort(key)
        length *= 2


def repeated(data: np.ndarray, least: int) -> np.ndarray:
    """For each place, whether the ``least`` bytes there also start elsewhere.

    Places from which fewer bytes are left, or a separator is nearer than that,
    mean nothing: callers know where their strings end.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, bool)
    order = suffix_array(data, least)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    # Where the suffix one symbol longer stands, and that symbol: the transform.
    longer = inverse[order - 1]
    longer[order == 0] = -1
    symbol = data[order - 1]
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    low, high = np.array([0]), np.array([n])
    for level in range(least):
        if not len(low):
            break
        size = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(low)), size)
        target = longer[at]
        sound = target >= 0
        if level == 0:
            # All one-symbol intervals, and the first boundaries.
            counts = np.bincount(data, minlength=256)
            ends = np.cumsum(counts)
            starts, ends = ends - counts, ends
            keep = (counts > 0) & (np.arange(256) != SEPARATOR)
            child_low, child_high = starts[keep], ends[keep]
            met[starts[counts > 0]] = True
            low, high = child_low, child_high
            continue
        plain = sound & (symbol[at] != SEPARATOR)
        target, owner, mark = target[plain], owner[plain], symbol[at][plain]
        if not len(target):
            break
        # Places with one symbol before them form one interval of that symbol.
        by = np.argsort(target)
        target, owner, mark = target[by], owner[by], mark[by]
        new = np.empty(len(target), bool)
        new[0] = True
        new[1:] = (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])
        first = np.flatnonzero(new)
        child_low = target[first]
        child_high = child_low + np.diff(np.append(first, len(target)))
        unmet = ~met[child_high]
        met[child_high] = True
        # Intervals whose end was met before hold nothing new.
        low, high = child_low[unmet], child_high[unmet]
    beyond = ~met[:n]
    same = beyond.copy()
    same[:-1] |= beyond[1:]
    out = np.zeros(n, bool)
    out[order] = same
    return out
