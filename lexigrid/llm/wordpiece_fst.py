"""Token counting with a compiled finite-state transducer (operator 5).

A byte-pair vocabulary with an end-of-word suffix is compiled, lazily, into a
deterministic transducer over bytes.  After reading a prefix ``p`` of a word its
running total is the number of tokens that ``p`` would have if the word ended
there, and every transition is annotated with the change of that total.  A state
keeps what the future can still see: each position where a vocabulary entry may
have begun, with the token that ends there and the number of tokens up to it.
That is enough because an encoding of ``p`` is the encoding of a shorter prefix
plus one last token, and a last token fits when it does not merge with the token
before it.

Texts are cut into chunks of equal length that are run in lockstep.  The state
in which a chunk is entered is unknown at first; the first byte of a word forgets
it, so a chunk with one has a constant state map.  The map of a chunk inside a long
word is held as the entries that were asked for.  It is nearly always constant too, as
a vocabulary forgets what lies some tokens back.  So a scan composes the maps with the
exits known so far, all chunks for which an entry was missing are run in lockstep, and
the scan is repeated until none is missing: a round or two, whatever the length of the
word.  Chunks of equal bytes share a map, so that words of one repeated piece, which
never forget, are composed by looking up.

Memory is bounded: tables hold at most ``max_states`` states and are rebuilt
when full, which changes no result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from tokenizers import Regex, Tokenizer, pre_tokenizers

# Fixed values of the tokenizer file format: contractions of its split pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def byte_alphabet() -> dict[int, str]:
    """The usual printable stand-in for each byte of byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    spare = 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


#: Code points of a page of the tables, which are made for the pages that texts have.
PAGE = 0x1000


def _page_points(page: int) -> list[int]:
    return [c for c in range(page * PAGE, (page + 1) * PAGE) if not 0xD800 <= c < 0xE000]


def _page_classes(page: int) -> np.ndarray:
    """Class of every code point of a page, as the tokenizers library's patterns see
    it."""
    table, points = np.full(PAGE, _OTHER, np.uint8), _page_points(page)
    if not points:
        return table
    whole, kinds = "".join(map(chr, points)), np.full(len(points), _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        for _, (start, stop) in split.pre_tokenize_str(whole):
            kinds[start:stop] = kind
    table[np.array(points) - page * PAGE] = kinds
    return table


def _normalize(text: str) -> str:
    if text.isascii():
        return text.lower()
    # The library lower-cases by character: no final sigma.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _page_odd(library, page: int) -> np.ndarray:
    """Code points of a page that Python and the library know differently (versions
    of Unicode), and surrogates; a text with one of them is left to the library."""
    odd, points = np.ones(PAGE, bool), _page_points(page)
    odd[np.array(points, np.int64) - page * PAGE] = False
    block = [chr(x) for x in points if x != 0x7C]
    theirs = library.normalize_str("|".join(block)).split("|") if block else []
    for char, said in zip(block, theirs):
        if unicodedata.category(char) == "Cn":
            odd[ord(char) - page * PAGE] = True
        elif said != _normalize(char) and not (said == " " and char.isspace()):
            odd[ord(char) - page * PAGE] = True
    return odd


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Transducer:
    """Lazily compiled counting transducer of one tokenizer file."""

    def __init__(self, path: str, max_states: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special_re = regex.compile("|".join(map(regex.escape, self.specials)))
        self.max_states = max_states
        self.library = Tokenizer.from_file(path)
        self.classes = np.full(0x110000, _OTHER, np.uint8)
        self.odd = np.zeros(0x110000, bool)
        self.pages = np.zeros(0x110000 // PAGE, bool)
        self._compile_vocabulary(model)
        self._reset()

    def _know(self, points: np.ndarray) -> None:
        """Fill the tables for the pages of some code points."""
        pages = points >> 12
        if self.pages[pages].all():
            return
        for page in np.unique(pages[~self.pages[pages]]).tolist():
            here = slice(page * PAGE, (page + 1) * PAGE)
            self.classes[here] = _page_classes(page)
            self.odd[here] = _page_odd(self.library.normalizer, page)
            self.pages[page] = True

    # -- vocabulary ---------------------------------------------------------

    def _compile_vocabulary(self, model: dict) -> None:
        to_byte = {c: b for b, c in byte_alphabet().items()}
        end, vocab = self.suffix, model["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        # Trie nodes: children by byte, token that ends here inside a word,
        # token that ends here and ends the word.
        self.child: list[dict[int, int]] = [{}]
        self.inner: list[int] = [-1]
        self.final: list[int] = [-1]
        self.symbols: dict[int, list[int]] = {}
        for token, i in vocab.items():
            ends = token.endswith(end)
            body = token[: -len(end)] if ends else token
            if not body or any(c not in to_byte for c in body):
                continue
            at, units = 0, []
            for k, c in enumerate(body):
                nxt = self.child[at].get(to_byte[c])
                if nxt is None:
                    nxt = self.child[at][to_byte[c]] = len(self.child)
                    self.child.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                at = nxt
                units.append(vocab[c + end] if ends and k == len(body) - 1 else vocab[c])
            (self.final if ends else self.inner)[at] = i
            self.symbols[i] = units
        self.pair_ok: dict[tuple[int, int], bool] = {}

    def _fits(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` stays as these two tokens."""
        if a < 0:
            return True
        known = self.pair_ok.get((a, b))
        if known is None:
            parts = self.symbols[a] + self.symbols[b]
            rank = self.rank
            while len(parts) > 1:
                best = min(
                    (rank[p] for p in zip(parts, parts[1:]) if p in rank),
                    default=None,
                )
                if best is None:
                    break
                merged, k = [], 0
                while k < len(parts):
                    if k + 1 < len(parts) and rank.get((parts[k], parts[k + 1])) == best:
                        merged.append(best[1])
                        k += 2
                    else:
                        merged.append(parts[k])
                        k += 1
                parts = merged
            known = parts == [a, b]
            if len(self.pair_ok) > 1_000_000:
                self.pair_ok.clear()
            self.pair_ok[a, b] = known
        return known

    # -- states -------------------------------------------------------------

    def _reset(self) -> None:
        # State 0 stands for "not known yet": it stays and counts nothing.
        # State 1 is a word's beginning.
        self.keys: list[tuple] = [(), ((0, -1, 0),)]
        self.ids: dict[tuple, int] = {}
        # One column for each byte value met so far; only met ones take room.
        self.column = np.full(256, -1, np.int64)
        self.met = 0
        self.next = np.full((1024, 64), -1, np.int32)
        self.delta = np.zeros((1024, 64), np.int8)
        self.next[0] = 0

    def _grow(self, rows: int, columns: int) -> None:
        for name, empty in (("next", -1), ("delta", 0)):
            old = getattr(self, name)
            new = np.full((rows, columns), empty, old.dtype)
            new[: old.shape[0], : old.shape[1]] = old
            new[0] = 0
            setattr(self, name, new)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = self.met
                self.met += 1
        if self.met > self.next.shape[1]:
            self._grow(len(self.next), 2 * self.next.shape[1])
        return self.column[data].astype(np.uint8)

    def _state(self, key: tuple) -> int:
        """The number of a state, a new one where it has none."""
        number = 1 if key == self.keys[1] else self.ids.get(key)
        if number is None:
            number = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if number >= len(self.next):
                self._grow(len(self.next) * 3 // 2, self.next.shape[1])
        return number

    def _step(self, state: int, byte: int) -> None:
        """Compile one transition."""
        entries, here, ended, moved = self.keys[state], None, None, []
        for node, last, count in entries:
            nxt = self.child[node].get(byte)
            if nxt is None:
                continue
            if here is None and self.inner[nxt] >= 0 and self._fits(last, self.inner[nxt]):
                here = (0, self.inner[nxt], count + 1)
            if ended is None and self.final[nxt] >= 0 and self._fits(last, self.final[nxt]):
                ended = count + 1
            if self.child[nxt]:
                moved.append((nxt, last, count))
        if here is None or ended is None:
            raise ValueError(f"byte {byte} has no encoding in this vocabulary")
        key = tuple((n, t, c - ended) for n, t, c in (*moved, here))
        target = self._state(key)
        self.next[state, self.column[byte]] = target
        self.delta[state, self.column[byte]] = ended  # relative to the last total

    def _advance(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # ``column`` is the byte's column in the tables.
        at = state * np.int64(self.next.shape[1]) + column
        new = self.next.ravel()[at]
        if (new < 0).any():
            names = np.flatnonzero(self.column >= 0)
            names = names[np.argsort(self.column[names])]
            lost = np.unique(at[new < 0])
            for x in lost.tolist():
                self._step(x // self.next.shape[1], int(names[x % self.next.shape[1]]))
            new = self.next.ravel()[at]
        return new, self.delta.ravel()[at]

    # -- runs ---------------------------------------------------------------

    def run(self, data: np.ndarray, first: np.ndarray, width: int = 96, piece: int = 1 << 19) -> np.ndarray:
        """Change of the total at each byte; ``first`` marks words' first bytes.

        Data of more than ``piece`` bytes are run in pieces, of which each is entered
        in the state that the one before left, so tables can be rebuilt inside a word.
        """
        out, left = [np.zeros(0, np.int8)], self.keys[1]
        piece = max(1, piece // width) * width  # whole chunks, so that exits are states of the data
        for start in range(0, len(data), piece):
            if len(self.keys) > self.max_states:
                self._reset()
            entry = self._state(left)
            change, end = self._run(data[start : start + piece], first[start : start + piece], width, entry)
            out.append(change)
            left = self.keys[end]
        return np.concatenate(out)

    def _run(self, data: np.ndarray, first: np.ndarray, width: int, entry: int) -> tuple[np.ndarray, int]:
        """Changes, and the state after the last byte."""
        n = len(data)
        rows = -(-n // width)
        grid = np.zeros(rows * width, np.uint8)
        grid[:n] = self._columns(data)
        flags = np.ones(rows * width, bool)
        flags[:n] = first
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        flags = np.ascontiguousarray(flags.reshape(rows, width).T)
        out = np.zeros((width, rows), np.int8)
        state = np.zeros(rows, np.int32)
        for k in range(width):
            state[flags[k]] = 1
            state, out[k] = self._advance(state, grid[k])
        head = np.where(flags.any(0), flags.argmax(0), width)
        todo = np.flatnonzero(head > 0)
        before = np.concatenate([[np.int32(entry)], state])
        self._compose(grid, before, todo[head[todo] == width])
        at = before[todo]
        for k in range(int(head[todo].max(initial=0))):
            live = head[todo] > k
            at[live], out[k, todo[live]] = self._advance(at[live], grid[k, todo[live]])
        return out.T.reshape(-1)[:n], int(before[-1])

    def _compose(self, grid: np.ndarray, before: np.ndarray, inside: np.ndarray) -> None:
        """States in which the chunks after those ``inside`` long words are entered."""
        if not len(inside):
            return
        _, same = np.unique(grid[:, inside], axis=1, return_inverse=True)
        chunks, same = inside.tolist(), same.ravel().tolist()
        known: list[dict[int, int]] = [{} for _ in range(max(same) + 1)]
        usual = [1] * len(known)  # a guess at the exit where an entry is missing
        while True:
            missing, last, end = {}, -2, 0
            for chunk, kind in zip(chunks, same):
                entry = end if chunk == last + 1 else int(before[chunk])
                end = known[kind].get(entry, 0)
                if not end:
                    missing.setdefault((kind, entry), chunk)
                    end = usual[kind]
                before[chunk + 1], last = end, chunk
            if not missing:
                return
            at, columns = np.array([e for _, e in missing], np.int32), grid[:, list(missing.values())]
            for k in range(len(grid)):
                at, _ = self._advance(at, columns[k])
            for (kind, entry), end in zip(missing, at.tolist()):
                known[kind][entry] = usual[kind] = end

    def _segments(self, text: str) -> tuple[list[str], int]:
        if "<|" not in text:
            return [text], 0
        parts = self.special_re.split(text)
        return parts, len(parts) - 1

    def counts(self, batch: list[str]) -> np.ndarray:
        """Number of tokens of each text, special strings included."""
        added = np.zeros(len(batch), np.int64)
        parts, owner = [], []
        for i, text in enumerate(batch):
            ours = text.isascii()
            if not ours:
                points = _points(text)
                self._know(points)
                ours = not self.odd[points].any()
            if not ours:
                added[i] = len(self.library.encode(text, add_special_tokens=False).ids)
                continue
            segments, added[i] = self._segments(text)
            for s in segments:
                # A space keeps words of neighbouring segments apart.
                parts.append(_normalize(s) + " ")
                owner.append(i)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        whole = "".join(parts)
        if not whole:
            return added
        points = _points(whole)
        self._know(points)
        kind = self.classes[points]
        doc = np.repeat(np.asarray(owner, np.int64), sizes)
        first = np.empty(len(points), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == _NUMBER
        marks = np.flatnonzero((points == 0x27) & first)
        for p in marks.tolist():
            for c in CONTRACTIONS:
                if whole.startswith(c, p + 1):
                    first[p + 1] = False
                    if p + 1 + len(c) < len(first):
                        first[p + 1 + len(c)] = True
                    break
        keep = kind != _SPACE
        points, first, doc = points[keep], first[keep], doc[keep]
        if not len(points):
            return added
        if points.max() < 0x80:
            data = points.astype(np.uint8)
        else:
            text = points.tobytes().decode("utf-32-le", "surrogatepass")
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            lead = (data & 0xC0) != 0x80
            index = np.cumsum(lead) - 1
            first, doc = first[index] & lead, doc[index]
        change = self.run(data, first)
        total = np.bincount(doc, weights=change, minlength=len(batch))
        return added + np.rint(total).astype(np.int64)
