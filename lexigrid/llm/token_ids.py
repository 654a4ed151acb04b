"""Encoding of whole texts to token ids, word by word through a cache.

The tokenizer drops white space and never joins across it, so a text's ids are
its words' ids one after another, and words repeat.  The library encodes each
word once, as long as a bounded cache remembers it.  Texts of Latin letters,
digits and signs, which are split and looked up a batch at a time, go by the
hashes of their words; others go by the words themselves.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import hash_words

_INFORMATION_SEPARATORS = re.compile("[\x1c-\x1f]")
_PLAIN_SPACE = re.compile(r"[ \t\n\r]+")


#: Texts without these consist of Latin letters, digits, signs and plain white
#: space; there the tokenizer splits between signs and all else.
_UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x7f'\x80-\xbf\xd7\xf7\u0100-\U0010ffff]")


class _Generation(dict):
    """Word -> row of a table of ids; a new word gets a row and is queued."""

    def __init__(self):
        super().__init__()
        self.queue: list[str] = []
        self.flat, self.offset = array.array("I"), array.array("q", [0])

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.queue.append(word)
        return row

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append the ids of the queued words, in their order."""
        self.queue.clear()
        ends = self.offset[-1] + np.cumsum(sizes)
        self.flat.frombytes(ids.tobytes())
        self.offset.frombytes(ends.astype(np.int64).tobytes())

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and the number of ids of each."""
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        return _take(flat, np.frombuffer(self.offset, np.int64), rows)


def _take(flat: np.ndarray, offset: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = offset[rows]
    sizes = offset[rows + 1] - first
    ends = np.cumsum(sizes)
    return flat[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


#: Of each byte: 0 white space, 1 sign, 2 all else.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = 1
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class _HashTable:
    """Hash of a word -> its ids, by open addressing, all words of a batch at once."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        slots = 1 << (2 * self.most - 1).bit_length()
        self.mask = np.int64(slots - 1)
        self.keys, self.rows, self.used = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0
        self.flat, self.offset = array.array("I"), array.array("q", [0])

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Slot that holds each hash, or the free one where it belongs."""
        at = (h >> np.uint64(20)).astype(np.int64) & self.mask
        rest = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            held = self.keys[at[rest]]
            rest = rest[(held != h[rest]) & (held != 0)]
        return at

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash, and whether it is known."""
        at = self._slots(h)
        return self.rows[at], self.keys[at] == h

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append new hashes, which are distinct."""
        waiting = np.arange(len(h))
        rows = self.used + np.arange(len(h))
        while len(waiting):
            at = self._slots(h[waiting])
            self.keys[at] = h[waiting]  # of those that want one slot the last gets it
            won = self.keys[at] == h[waiting]
            self.rows[at[won]] = rows[waiting[won]]
            waiting = waiting[~won]
        self.used += len(h)
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.offset.frombytes((self.offset[-1] + np.cumsum(sizes)).astype(np.int64).tobytes())

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        return _take(flat, np.frombuffer(self.offset, np.int64), rows)


class WordEncoder:
    """Cache of words in two generations: a full one becomes the older, from
    which words still in use are taken over without the library."""

    def __init__(self, path: str, max_words: int = 100_000, max_hashes: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = re.compile(
            "(" + "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) + ")"
        )
        self.max_words = max_words
        self.young, self.old = _Generation(), _Generation()
        self.table = _HashTable(max_hashes)

    def _learn(self) -> None:
        """Find the ids of queued words, from the older generation if it can."""
        young, old = self.young, self.old
        words = young.queue
        known = [k for k, w in enumerate(words) if w in old]
        ask = [k for k, w in enumerate(words) if w not in old]
        parts = [old.take(np.fromiter((old[words[k]] for k in known), np.int64, len(known)))]
        got = [e.ids for e in self.library.encode_batch([words[k] for k in ask], add_special_tokens=False)]
        parts.append((np.array([i for one in got for i in one], np.uint32), np.array([len(one) for one in got], np.int64)))
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        young.add(*_take(ids, np.concatenate(([0], np.cumsum(sizes))), np.argsort(known + ask)))

    def _words(self, text: str) -> list[str]:
        if "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.specials.split(text)):
                out += [part] if k % 2 else self._words(part) if "<|" not in part else self._split(part)
            return out
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        # str.split() also splits at four control characters that the
        # library keeps.
        if _INFORMATION_SEPARATORS.search(text):
            return [w for w in _PLAIN_SPACE.split(text) if w]
        return text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        unusual = [bool(_UNUSUAL.search(t)) or "<|" in t for t in texts]
        if not any(unusual):
            return self._by_hash(texts)
        if all(unusual):
            return self._by_word(texts)
        kinds = np.array(unusual)
        ids, sizes = zip(
            self._by_hash([t for t, u in zip(texts, unusual) if not u]),
            self._by_word([t for t, u in zip(texts, unusual) if u]),
        )
        order = np.argsort(np.argsort(kinds, kind="stable"), kind="stable")
        offset = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return _take(np.concatenate(ids), offset, order)

    def _by_hash(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.table.used > self.table.most // 2:
            self.table.clear()
        raw = [t.encode() + b" " for t in texts]
        data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        # Capitals among the two-byte letters, all of which begin with 0xC3.
        data[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).astype(np.uint8) << 5
        kind = _CLASS[data]
        new = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        stop = np.append(new[1:], len(data))
        word = kind[new] > 0
        first, last = new[word], stop[word]
        h = hash_words(data, first, last - first) | np.uint64(1)
        rows, known = self.table.find(h)
        if not known.all():
            lost = np.flatnonzero(~known)
            fresh, at = np.unique(h[lost], return_index=True)
            at, whole = lost[at], data.tobytes()
            words = [whole[a:b].decode() for a, b in zip(first[at].tolist(), last[at].tolist())]
            ids, sizes = self._ask(words)
            if self.table.used + len(fresh) > self.table.most:
                # A part with very many new words gets a larger table.
                self.table = _HashTable(2 * len(h))
                return self._by_hash(texts)
            self.table.add(fresh, ids, sizes)
            rows, _ = self.table.find(h)
        ids, sizes = self.table.take(rows)
        after = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.searchsorted(first, np.cumsum([len(r) for r in raw]))
        return ids, np.diff(after[ends], prepend=0)

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words from the library.  Words of letters alone are one piece
        each, so it takes those as one text."""
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        rest = [k for k, w in enumerate(words) if not w.isalpha()]
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if plain:
            got = self.library.encode(" ".join([words[k] for k in plain]), add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            sizes.append(np.bincount(got.word_ids, minlength=len(plain)))
        if rest:
            got = [e.ids for e in self.library.encode_batch([words[k] for k in rest], add_special_tokens=False)]
            ids.append(np.array([i for one in got for i in one], np.uint32))
            sizes.append(np.array([len(one) for one in got]))
        order = np.argsort(plain + rest)
        offset = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return _take(np.concatenate(ids), offset, order)

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.young) > self.max_words or len(self.young.flat) > 1 << 24:
            self.young, self.old = _Generation(), self.young
        words: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            words += self._words(t)
            ends[k] = len(words)
        young = self.young
        rows = np.fromiter(map(young.__getitem__, words), np.int64, len(words))
        if young.queue:
            self._learn()
        ids, sizes = young.take(rows)
        after = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(after[ends], prepend=0)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 20) -> Iterator[tuple[slice, list[str]]]:
    """Parts of a batch with about ``size`` bytes of text, a longer text alone.

    Only one part at a time is made into Python strings.
    """
    values = batch.column(column)
    lengths = pc.binary_length(values).to_numpy(zero_copy_only=False)
    start = room = 0
    for k, n in enumerate(lengths.tolist()):
        if k > start and room + n > size:
            yield slice(start, k), values.slice(start, k - start).to_pylist()
            start, room = k, 0
        room += n
    if start < len(values):
        yield slice(start, len(values)), values.slice(start).to_pylist()


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int):
    """For each part: the other columns, ids with ``end_id`` after each text,
    and where each text's ids end."""
    words = encoder(path)
    for batch in batches:
        for part, texts in slices(batch):
            ids, sizes = words.encode(texts)
            stops = np.cumsum(sizes)
            with_end = np.insert(ids, stops, end_id)
            yield batch.slice(part.start, part.stop - part.start), with_end, stops + np.arange(1, len(texts) + 1)
