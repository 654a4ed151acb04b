"""Hashes of the words of many texts at once.

Words are runs of bytes that are not ASCII white space, with A to Z lower-cased.
"""

from __future__ import annotations

import numpy as np
import xxhash

POWER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at once.
STEP = 1 << 22
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    inverse = np.uint64(pow(int(POWER), -1, 1 << 64))
    up = np.cumprod(np.full(n, POWER, np.uint64), dtype=np.uint64)
    down = np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)
    return up, down


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers, for ``n`` places at least."""
    if not _tables or len(_tables[0][0]) < n:
        _tables[:] = [_powers(max(1 << 21, n))]
    return _tables[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


#: Bytes that end words: ASCII white space, and with it ASCII signs.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SIGNS = _WHITE.copy()
_SIGNS[[b for b in range(0x80) if not chr(b).isalnum()]] = True


def word_hashes(values: list[str], signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and where each text's words end.

    With ``signs`` words also end at ASCII signs, which belong to no word.
    """
    raw = [v.encode("utf-8", "surrogatepass").lower() + b" " for v in values]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    space = (_SIGNS if signs else _WHITE)[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    first, last = edge[0::2], edge[1::2]  # every text ends with a space
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(values), np.int64)
    return np.concatenate([_hashed(data, first[a:b], last[a:b]) for a, b in _groups(first)]), np.searchsorted(first, ends)


def _groups(first: np.ndarray) -> list[tuple[int, int]]:
    """Words by number, so that those of a group begin within STEP bytes: a text of any
    length is hashed in bounded memory but for its longest word."""
    cuts = np.searchsorted(first, np.arange(int(first[0]), int(first[-1]) + 1, STEP))
    cuts = np.unique(np.append(cuts, len(first))).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def _hashed(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``first`` to before ``last``."""
    base = int(first[0])
    return hash_words(data[base : int(last[-1])], first - base, last - first)


#: Bytes of words that are hashed together; longer ones are hashed alone.
TOGETHER = 64
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_words(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` bytes from each ``first`` on, eight bytes at a time.

    Every eight bytes are mixed before the next come in, so that no pattern of bytes
    cancels out, as it may in a sum of powers; words of eight bytes and less have
    different hashes.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    h = mix((eight[first] & _KEPT[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * POWER))
    rest = np.flatnonzero((size > 8) & (size <= TOGETHER))
    at, left = first[rest] + 8, size[rest] - 8
    while len(rest):
        h[rest] = mix(h[rest] * POWER ^ (eight[at] & _KEPT[np.minimum(left, 8)]))
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > TOGETHER).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[first[k] : first[k] + size[k]])
    return h


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` hashes in a row, from those of half as many; the last half
    overlaps where ``n`` is no power of two."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    reach = 1
    while 2 * reach <= n:
        h = mix(h[: len(h) - reach] * POWER + h[reach:])
        reach *= 2
    over = n - reach
    return mix(h[: len(h) - over] * POWER + h[over:]) if over else h
