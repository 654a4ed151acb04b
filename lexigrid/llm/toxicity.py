"""Operator 4: toxicity by a classifier chain of linear models.

The chain predicts the categories that the labels name, one after another:

* ``junk``: the text is of low quality (``quality`` is 0),
* ``toxic``: it is toxic.

Each is a logistic regression over evidence from words and measures of signs.  Its
evidence is which words, and beginnings of words of 3 to 8 letters, are more frequent
in labelled rows of the category; beginnings matter because in compounding languages
the offending part opens many different words.  Words are runs of letters, lower-cased.
A later model also sees the earlier categories' probabilities.

Everything that is learned from labels is learned out of fold: the evidence of a
training row comes from the other folds' rows, and so do the earlier probabilities,
whose models select their words and are fitted without the row's fold.  Rows of
equal text share a fold.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .token_ids import slices

CATEGORIES = ("junk", "toxic")
#: Largest number of labelled rows that the models are trained on.
MAX_TRAIN = 4000
#: Folds of the training rows.
FOLDS = 4
_PREFIXES = range(3, 9)
#: A word or beginning is evidence if so many rows of the category have it, from this
#: log lift on, and with so many other rows a row of the category at most; from the
#: higher lift on it is strong.
LEAST_ROWS, LIFT, OTHERS, STRONG = 3, 1.0, 4, 4.0
_WORDS = regex.compile(r"\p{L}+")
#: Bytes that are counted in a text: signs, digits, capitals, ends of lines.
_COUNTED = tuple(np.array([ord(c) for c in cs]) for cs in ("#*$%&|<>", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\n", "!?"))


def features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    part = word[:64]
    out = [xxhash.xxh3_64_intdigest("=" + word)]
    out += [xxhash.xxh3_64_intdigest("^" + part[:k]) for k in _PREFIXES if len(word) >= k]
    return tuple(out)


def read(text: str) -> tuple[set[str], list[float]]:
    """A text's distinct words, and measures of its signs."""
    words = _WORDS.findall(text.lower())
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    known = set(words)
    shares = [float(np.log1p(100 * counts[c].sum() / (len(raw) + 1))) for c in _COUNTED]
    return known, [*shares, len(known) / (len(words) + 1), float(np.log1p(len(words)))]


def _evidence(held: Sequence[tuple[int, ...]], size: int, lifts: dict[int, float]) -> list[float]:
    """Measures of the words that speak for a category, of ``size`` distinct words:
    in a long text one is more likely to be there by chance."""
    found = []
    for fs in held:
        best = max((lifts[f] for f in fs if f in lifts), default=0.0)
        if best:
            found.append(best)
    hits = len(found)
    if not hits:
        return [0.0] * 9
    log_size = float(np.log1p(size))
    more = float(np.log1p(hits))
    return [
        1, hits > 1, more, log_size, more * log_size, float(np.log(hits / size)),
        max(found), sum(found) / 10, min(2, sum(e >= STRONG for e in found)),
    ]


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps with a quadratic penalty."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (y - p) - ridge * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def folds(values: list[str]) -> np.ndarray:
    """The fold of each text; equal texts share one."""
    return np.array([xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) % FOLDS for v in values], np.int64)


class Training:
    """Labelled rows by fold, and evidence that leaves folds out."""

    def __init__(self, rows: list[tuple[Collection[str], list[float]]], fold: np.ndarray, y: np.ndarray):
        self.fold, self.y = fold, y
        self.signs = np.array([s for _, s in rows], float).reshape(len(rows), -1)
        self.sizes = [len(words) for words, _ in rows]
        # Only features of rows of the category can be evidence for it.
        own = [np.array(sorted({f for w in words for f in features(w)}), np.uint64) for (words, _), label in zip(rows, y.tolist()) if label]
        every, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.names = every[counts >= LEAST_ROWS]
        at = {f: k for k, f in enumerate(self.names.tolist())}
        same = {f: f for f in at}
        known: dict[str, tuple[int, ...]] = {}
        self.words: list[list[tuple[int, ...]]] = []
        for words, _ in rows:
            held = []
            for w in words:
                kept = known.get(w)
                if kept is None:
                    kept = known[w] = tuple(same[f] for f in features(w) if f in same)
                if kept:
                    held.append(kept)
            self.words.append(held)
        self.counts = np.zeros((2, FOLDS, len(self.names)), np.int64)
        for fs, label, k in zip(self.words, y.tolist(), fold.tolist()):
            self.counts[label, k, [at[f] for f in {f for word in fs for f in word}]] += 1
        self.tables: dict[frozenset[int], dict[int, float]] = {}
        # Most features are evidence whatever folds are left out, or never.
        left_out = {frozenset((j, k)) for j in range(FOLDS) for k in range(FOLDS)} | {frozenset()}
        ever = frozenset().union(*map(self.lifts, left_out))
        self.words = [[kept for fs in held if (kept := tuple(f for f in fs if f in ever))] for held in self.words]

    def lifts(self, without: frozenset[int] = frozenset()) -> dict[int, float]:
        """Features that rows of the category have clearly more often than others,
        with their log lifts less two standard errors, counted without some folds."""
        if without not in self.tables:
            used = [k for k in range(FOLDS) if k not in without]
            rest, own = self.counts[:, used].sum(1)
            inside = np.isin(self.fold, used)
            n1, n0 = (max(1, int((inside & (self.y == label)).sum())) for label in (1, 0))
            lift = np.log((own + 0.5) / (n1 + 1)) - np.log((rest + 0.5) / (n0 + 1)) - 2 / np.sqrt(np.maximum(1, own))
            kept = (own >= LEAST_ROWS) & (lift >= LIFT) & (rest <= OTHERS * own)
            self.tables[without] = dict(zip(self.names[kept].tolist(), lift[kept].tolist()))
        return self.tables[without]

    def matrix(self, rows: np.ndarray, without: frozenset[int] = frozenset(), and_own: bool = True) -> np.ndarray:
        """Evidence and signs of rows, from folds but ``without`` and, with
        ``and_own``, each row's own."""
        out = []
        for r in rows.tolist():
            lifts = self.lifts(without | {int(self.fold[r])} if and_own else without)
            out.append(_evidence(self.words[r], self.sizes[r], lifts))
        return np.hstack([np.array(out, float).reshape(len(out), 9), self.signs[rows]])

    def unseen(self, earlier: np.ndarray) -> np.ndarray:
        """Each row's probability by a model whose words and weights come from the
        other folds only."""
        p = np.zeros(len(self.y))
        for k in range(FOLDS):
            test, rest = np.flatnonzero(self.fold == k), np.flatnonzero(self.fold != k)
            if not len(test) or not len(rest):
                continue
            w = _fit(np.hstack([self.matrix(rest, frozenset([k])), earlier[rest]]), self.y[rest])
            p[test] = _apply(w, np.hstack([self.matrix(test, frozenset([k])), earlier[test]]))
        return p

    def weights(self, earlier: np.ndarray) -> np.ndarray:
        every = np.arange(len(self.y))
        return _fit(np.hstack([self.matrix(every), earlier]), self.y)


@dataclass
class Chain:
    """A trained chain: of each category the features with their lifts, and weights."""

    lifts: list[dict[int, float]]
    weights: list[np.ndarray]
    threshold: float = 0.5

    def predict(self, held: list[tuple[list[tuple[int, ...]], int, list[float]]]) -> np.ndarray:
        """Probabilities of texts, given as (features of words, words, signs)."""
        p = np.zeros((len(held), len(self.weights)))
        signs = np.array([s for _, _, s in held], float).reshape(len(held), -1)
        for k, (lifts, w) in enumerate(zip(self.lifts, self.weights)):
            x = np.array([_evidence(fs, size, lifts) for fs, size, _ in held], float).reshape(len(held), 9)
            p[:, k] = _apply(w, np.hstack([x, signs, p[:, :k]]))
        return p


def train(values: list[str], labels: list[np.ndarray]) -> Chain:
    """Train the chain on labelled texts, with 0 or 1 of each category."""
    chain, earlier = Chain([], []), np.zeros((len(values), 0))
    fold = folds(values)
    # Rows share their words: as sets of their own they would be most of the memory.
    one: dict[str, str] = {}
    rows = [(tuple(one.setdefault(w, w) for w in words), signs) for words, signs in map(read, values)]
    for k, y in enumerate(labels):
        if not y.any():
            # Nothing to learn from: nothing is in the category.
            chain.lifts.append({})
            chain.weights.append(np.append(np.zeros(9 + len(read("")[1]) + k), -30.0))
            earlier = np.hstack([earlier, np.zeros((len(values), 1))])
            continue
        own = Training(rows, fold, y)
        chain.lifts.append(own.lifts())
        chain.weights.append(own.weights(earlier))
        if k + 1 < len(labels):
            earlier = np.hstack([earlier, own.unseen(earlier)[:, None]])
    return chain


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain:
    """Train on at most ``max_train`` labelled rows, chosen by hash of the id.

    ``labels`` has ``doc_id``, ``toxic`` and, if junk is to be told, ``quality``; a
    row without a ``toxic`` label is not used, one without ``quality`` is no junk.
    """
    junk: Column = F.when(F.col("quality") == 0, 1).otherwise(0) if "quality" in labels.columns else F.lit(0)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(
        F.col("doc_id").cast("long"), junk.alias("junk"), F.col("toxic").cast("int").alias("toxic")
    )
    known = known.groupBy("doc_id").agg(F.max("junk").alias("junk"), F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_train)
    got = rows.select("text", *CATEGORIES).collect()
    return train([r["text"] for r in got], [np.array([int(r[c] > 0) for r in got], np.int64) for c in CATEGORIES])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability for each category, ``toxic`` and ``kept``.

    A null, empty or wordless text has no features and is kept; a null
    ``doc_id`` and repeated rows are scored each; an empty table gives an empty
    result; other columns are not read.  Without labelled toxic rows nothing is
    toxic.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(chain)
        for batch in batches:
            for part, values in slices(batch):
                p = predict(values)
                bad = p[:, -1] >= chain.threshold
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, len(values)),
                        *(pa.array(p[:, k]) for k in range(len(CATEGORIES))),
                        pa.array(bad),
                        pa.array(~bad),
                    ],
                    ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic", "kept"],
                )

    columns = ", ".join(f"p_{c} double" for c in CATEGORIES)
    return texts(docs).mapInArrow(run, f"doc_id long, {columns}, toxic boolean, kept boolean")


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not toxic."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(chain)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            filled = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(at), "")], ["text"])
            for part, values in slices(filled):
                clean = predict(values)[:, -1] < chain.threshold
                yield batch.slice(part.start, len(values)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


class Predictor:
    """Probabilities of texts; remembers which words have kept features."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.kept = frozenset().union(*chain.lifts)
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) > 150_000:
                self.known.clear()
            out = self.known[word] = tuple(f for f in features(word) if f in self.kept)
        return out

    def __call__(self, values: list[str]) -> np.ndarray:
        held = []
        for words, signs in map(read, values):
            held.append(([f for w in words if (f := self._of(w))], len(words), signs))
        return self.chain.predict(held)
