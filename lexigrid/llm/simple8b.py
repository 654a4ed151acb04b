"""Simple-8b word-aligned coding of unsigned integers, vectorised.

The four high bits of a 64-bit word select how its other 60 bits are divided.
Selector 0 is the escape: the next word holds one value of any 64-bit size.
"""

from __future__ import annotations

import numpy as np

#: (values in a word, bits of each), by selector; selector 0 is the escape.
LAYOUT = (
    (1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_COUNTS = np.array([c for c, _ in LAYOUT])


def _choose(values: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Selector of a word that would begin at each place: the fullest that fits.

    ``stop`` is the end of the run (the document) that each place belongs to.
    """
    n = len(values)
    here = np.arange(n)
    width = np.zeros(n, np.int8)
    big = values > 0
    width[big] = np.frexp(values[big].astype(np.float64))[1]
    # Doubles round up near a power of two beyond 53 bits: look again.
    near = np.flatnonzero(width > 53)
    for k in near.tolist():
        width[k] = int(values[k]).bit_length()
    room = stop - here
    narrow = np.cumsum(np.bincount(width, minlength=65))
    out = np.zeros(n, np.int8)
    for selector in range(len(LAYOUT) - 1, 0, -1):
        count, bits = LAYOUT[selector]
        if narrow[bits] == n:
            out[room >= count] = selector
        elif narrow[bits] >= count:
            wide = np.flatnonzero(width > bits)
            runs = np.diff(wide, prepend=-1, append=n) - 1
            if runs.max() < count:
                continue
            # Distance to the next value that is too wide for this selector.
            limit = np.repeat(np.append(wide, n), runs + 1)[:n] - here
            out[np.minimum(limit, room) >= count] = selector
    return out


def encode(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of runs that end at ``ends``, and the number of words of each run.

    A run starts a word of its own, so runs can be moved without coding anew.
    """
    values = np.ascontiguousarray(values, np.uint64)
    ends = np.asarray(ends, np.int64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    sizes = np.diff(ends, prepend=0)
    selector = _choose(values, np.repeat(ends, sizes))
    step = _COUNTS[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    room = np.where(chosen == 0, 2, 1)
    place = np.concatenate(([0], np.cumsum(room)))
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(chosen).tolist():
        at, to = starts[chosen == s], place[:-1][chosen == s]
        count, bits = LAYOUT[s]
        if s == 0:
            words[to + 1] = values[at]
            continue
        word = np.full(len(at), s << 60, np.uint64)
        for k in range(count if bits else 0):
            word |= values[at + k] << np.uint64(k * bits)
        words[to] = word
    bound = np.searchsorted(starts, ends)
    return words, np.diff(place[bound], prepend=0)


def decode(words: np.ndarray) -> np.ndarray:
    """The values of a block of words, all words of a selector at a time."""
    words = np.ascontiguousarray(words, np.uint64)
    n = len(words)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(n, bool)  # second words of escapes hold no selector
    for k in np.flatnonzero(selector == 0).tolist():
        if not raw[k]:
            raw[k + 1] = True
    lead = np.flatnonzero(~raw)
    selector = selector[lead]
    count = _COUNTS[selector]
    place = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(place[-1], np.uint64)
    for s in np.unique(selector).tolist():
        at, to = lead[selector == s], place[:-1][selector == s]
        size, bits = LAYOUT[s]
        if s == 0:
            out[to] = words[at + 1]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for k in range(size):
                out[to + k] = (words[at] >> np.uint64(k * bits)) & mask
    return out
