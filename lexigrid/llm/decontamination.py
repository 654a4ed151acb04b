"""Operator 3: benchmark decontamination by latent semantic retrieval.

Documents are read as passages of two or four neighbouring cells of words, short
ones for short benchmark items.  A passage is
a TF-IDF vector over the benchmark's vocabulary, in which a word counts once a cell,
however often it stands there, and one that most documents have counts little, but
counts.  A distributed randomised singular value decomposition of all documents' cells
and of the items, either half of the weight, gives a latent space.  Every passage of
every document is searched in it: items whose cosine reaches NEAR are candidates.
They are verified by the longest common subsequence of words, of the whole item and
of its end, where the answer stands; a bound from the words that both have, which no
match falls below, spares most of that work.  So reworded copies are found as well as
exact ones.  ``near=-2`` makes every item a candidate everywhere, against which the
search's recall is measured.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts
from .token_ids import slices
from .words import word_hashes

#: Words of a cell, and (cells of a passage, a power of two, most words of items
#: that it is compared with).  A passage begins at every cell.
CELL = 12
WIDTHS = ((2, 30), (4, 1 << 30))
#: Dimensions of the latent space, and more that the random test matrix has.
RANK, OVERSAMPLE = 128, 16
#: Least cosine of a passage and an item that are compared.  Of 600 items put whole
#: into other documents the least cosine is 0.93, of 600 with two in five of their
#: words exchanged 0.62.
NEAR = 0.4
#: Least weight of a word, so that items of frequent words only keep a vector.
LEAST_WEIGHT = 1e-3
#: Shares of the item's words, and of its end, that must appear in order:
#: either nearly the whole item, or enough of it together with the answer.
WHOLE, PART, ANSWER = 0.9, 0.6, 0.5
#: The end of an item: this share of its words, and at least so many.
END_SHARE, END_WORDS = 0.2, 3
#: Terms in a block of the matrix that tasks add up.
TERM_BLOCK = 256
#: Neighbouring passages that are bounded together, and most numbers of a matrix
#: that the search holds.
SPAN, BLOCK_CELLS = 16, 1 << 22
#: Arrays that are added at once.
FAN = 256
#: Rows of a run that are added one after another.
RUN = 16


def places(sequence: list[int]) -> dict[int, int]:
    """The places of each word of a sequence, as bits."""
    out: dict[int, int] = {}
    for k, x in enumerate(sequence):
        out[x] = out.get(x, 0) | (1 << k)
    return out


def lcs(where: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence of a sequence of ``size`` words,
    given by its :func:`places`, and another, a word of the other at a time."""
    full = (1 << size) - 1
    row = full
    for x in other:
        at = where.get(x)
        if at:
            hit = row & at
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _lower(text: str) -> str:
    """Lower case beyond A to Z, which the hashes see to."""
    return text if text.isascii() else text.lower()


class Items:
    """The benchmark's items as sequences of vocabulary numbers from 1."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        rows = [(i, t) for i, t in rows if i is not None and t and t.strip()]
        word, ends = word_hashes([_lower(t) for _, t in rows], signs=True) if rows else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.words, at = np.unique(word, return_inverse=True)
        parts = np.split(at + 1, ends[:-1]) if len(ends) else []
        held = [(i, p) for (i, _), p in zip(rows, parts) if len(p)]
        self.ids = [i for i, _ in held]
        self.sequences = [p.tolist() for _, p in held]

    def number(self, word: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, 0 for other words."""
        if not len(self.words):
            return np.zeros(len(word), np.uint32)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at + 1, 0).astype(np.uint32)


def _sequences(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_ids, sizes, numbers``: documents as vocabulary numbers, many a row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The few hashes of the vocabulary: most words are told apart by 20 bits.
        maybe = np.zeros(1 << 20, bool)
        maybe[items.words >> np.uint64(44)] = True
        for batch in batches:
            total = np.zeros(len(items.words) + 1, np.int64)
            done = 0
            # Small parts: what later steps make of a row stays in a core's cache.
            for part, values in slices(batch, size=1 << 17):
                word, ends = word_hashes([_lower(v) for v in values], signs=True)
                number = np.zeros(len(word), np.uint32)
                hit = np.flatnonzero(maybe[word >> np.uint64(44)])
                number[hit] = items.number(word[hit])
                seen = np.unique(np.repeat(np.arange(len(values)), np.diff(ends, prepend=0))[hit] * np.int64(len(items.words) + 1) + number[hit])
                total += np.bincount((seen % (len(items.words) + 1)).astype(np.int64), minlength=len(items.words) + 1)
                done += len(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("doc_id").slice(part.start, len(values)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.diff(ends, prepend=0).tolist()], pa.list_(pa.int64())),
                        pa.array([number.tobytes()], pa.binary()),
                        # One count of documents for all rows of the batch, in its last.
                        pa.array([total.astype("<i8").tobytes() if done == len(batch) else None], pa.binary()),
                    ],
                    ["doc_ids", "sizes", "numbers", "df"],
                )

    return docs.mapInArrow(run, "doc_ids array<long>, sizes array<long>, numbers binary, df binary")


def _added(rows: DataFrame, kind: str) -> DataFrame:
    """``block, part``: sums of binary arrays of numbers by block, in doubles.

    ``rows`` has ``block, shard, part`` with a shard a task.  They are added in
    three steps of FAN shards each, so a step holds FAN arrays whatever the
    number of tasks is, up to FAN^3 of them.
    """
    def add(kind: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(raw, kind).astype(np.float64) for raw in group["part"])
            return pd.DataFrame({"block": group["block"].iloc[:1], "shard": group["shard"].iloc[:1] // FAN, "part": [total.tobytes()]})

        return run

    for step in range(3):
        keys = ["block", F.floor(F.col("shard") / FAN)] if step < 2 else ["block"]
        rows = rows.groupBy(*keys).applyInPandas(add(kind), "block long, shard long, part binary")
        kind = "<f8"
    return rows.select("block", "part")


def run_sums(matrix: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of a matrix over runs that begin at ``start``.

    One place of all runs is added at a time, and long runs in pieces first, which for
    wide rows takes a fraction of the time of ``np.add.reduceat``.
    """
    size = np.diff(start, append=len(at))
    if size.max(initial=0) > RUN:
        pieces = -(-size // RUN)
        first = np.cumsum(pieces) - pieces
        piece = np.repeat(start - RUN * first, pieces) + RUN * np.arange(pieces.sum())
        return run_sums(run_sums(matrix, at, piece), np.arange(len(piece)), first)
    out = matrix.take(at[start], axis=0)
    for k in range(1, int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        out[more] += matrix.take(at[start[more] + k], axis=0)
    return out


class _Rows:
    """The passages' cells of one row of sequences."""

    def __init__(self, sizes: np.ndarray, numbers: bytes, weight: np.ndarray):
        self.number = np.frombuffer(numbers, np.uint32)
        self.sizes = np.asarray(sizes, np.int64)
        cells = np.maximum(1, -(-self.sizes // CELL))
        first_cell = np.cumsum(cells) - cells
        self.cells = int(cells.sum())
        begin = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.number)) - np.repeat(begin, self.sizes)
        cell = np.repeat(first_cell, self.sizes) + place // CELL
        self.owner, self.first = np.repeat(np.arange(len(cells)), cells), first_cell
        used = np.flatnonzero(weight[self.number] > 0)
        # A word counts once a cell.
        both = np.sort(cell[used] * len(weight) + self.number[used])
        both = both[np.diff(both, prepend=-1) > 0]
        self.cell, self.term = both // len(weight), both % len(weight)

    def project(self, basis: np.ndarray) -> np.ndarray:
        """Each cell's vector: the sum of the rows of its words in the basis."""
        out = np.zeros((self.cells, basis.shape[1]), np.float32)
        if len(self.cell):
            start = np.flatnonzero(np.diff(self.cell, prepend=-1))
            out[self.cell[start]] = run_sums(basis, self.term, start)
        return out

    def passages(self, cells: np.ndarray, width: int) -> np.ndarray:
        """Unit vectors of the passages of ``width`` cells that begin at each cell."""
        out = cells.copy()
        for k in range(1, width):
            inside = self.owner[k:] == self.owner[:-k]
            out[:-k][inside] += cells[k:][inside]
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1))[:, None]


class _Search:
    """Items near the passages of ``width`` cells, by spans of passages.

    What is near is bounded before it is compared: no common subsequence has more
    words than the item has of those in the span, so none that reaches PART is
    left out.
    """

    def __init__(self, sequences: list[list[int]], width: int, wanted: np.ndarray, query: np.ndarray):
        self.wanted, self.width, self.query = wanted, width, query[wanted]
        sizes = np.array([len(sequences[k]) for k in wanted.tolist()])
        self.reach, self.need = int(sizes.max()), PART * sizes - 1e-3
        self.words = np.zeros((len(wanted), self.reach), np.int64)
        for row, k in zip(self.words, wanted.tolist()):
            row[: len(sequences[k])] = sequences[k]
        self.step = SPAN * CELL
        #: Words from the start of a span to the end of its last passage's window.
        self.far = self.step - CELL + width * CELL + self.reach

    def candidates(self, sizes: np.ndarray, number: np.ndarray, passages: np.ndarray, terms: int, near: float) -> Iterator[tuple[int, int, int]]:
        """(document, span of it, item)."""
        cells = np.maximum(1, -(-sizes // CELL))
        spans = -(-cells // SPAN)
        first = np.cumsum(spans) - spans
        owner = np.repeat(np.arange(len(sizes)), spans)
        span_cell = (np.cumsum(cells) - cells)[owner] + (np.arange(len(owner)) - first[owner]) * SPAN
        close = []
        some = max(1, BLOCK_CELLS // max(1, len(passages)))
        for k in range(0, len(self.wanted), some):
            span, item = np.nonzero(np.logical_or.reduceat(passages @ self.query[k : k + some].T >= near, span_cell, axis=0))
            close.append((span, item + k))
        span, item = (np.concatenate(x) for x in zip(*close))
        order = np.argsort(span, kind="stable")
        span, item = span[order], item[order]
        if not len(span):
            return
        begin = np.cumsum(sizes) - sizes
        known = np.flatnonzero(number)
        doc = np.repeat(np.arange(len(sizes)), sizes)[known]
        place = known - begin[doc]
        # The first and last span whose windows hold each word.
        low = np.maximum(0, (place - self.far) // self.step + 1) + first[doc]
        high = np.minimum(spans[doc] - 1, (place + self.reach) // self.step) + first[doc]
        term = number[known]
        rows = max(1, BLOCK_CELLS // terms)
        for top in range(0, len(owner), rows):
            a, b = np.searchsorted(span, (top, top + rows))
            if a == b:
                continue
            there = np.zeros((min(rows, len(owner) - top), terms), bool)
            for k in range(int((high - low).max(initial=-1)) + 1):
                inside = (low + k <= high) & (low + k >= top) & (low + k < top + rows)
                there[low[inside] + k - top, term[inside]] = True
            there[:, 0] = False
            for start in range(a, b, 1 << 14):
                own, held = span[start : min(b, start + (1 << 14))], item[start : min(b, start + (1 << 14))]
                enough = there[(own - top)[:, None], self.words[held]].sum(1) >= self.need[held]
                for row, k in zip(own[enough].tolist(), held[enough].tolist()):
                    yield int(owner[row]), row - int(first[owner[row]]), int(self.wanted[k])


def find_leaks(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share, kept`` of every document
    and item that it holds; ``kept`` is false.

    The benchmark (``item_id, text``) is a stated query set that every task
    holds.  Items without id or words are found nowhere; null, empty and wordless
    documents hold nothing; a document shorter than a passage is one passage; a
    null ``doc_id`` is reported as null; rows that share an id are each read and
    reported once an item; without documents or items the result is empty; other
    columns are not read.
    """
    items = Items([(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").dropDuplicates().sort("item_id", "text").collect()])
    terms = len(items.words) + 1
    rows = materialize(_sequences(texts(docs), items), "sequences")
    # How many documents have each word of the vocabulary.
    n_docs = rows.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    shard = F.spark_partition_id().cast("long").alias("shard")
    in_batches = rows.where("df IS NOT NULL").select(F.lit(0).cast("long").alias("block"), shard, F.col("df").alias("part"))
    counted = _added(in_batches, "<i8").first()
    df = np.frombuffer(counted["part"], np.float64) if counted else np.zeros(terms)
    weight = np.zeros(terms, np.float32)
    told = df > 0
    told[0] = False
    weight[told] = np.maximum(LEAST_WEIGHT, np.log((n_docs + 1) / df[told]))
    if not weight.any():
        weight[1:] = 1
    rank = min(RANK + OVERSAMPLE, terms)
    test = np.random.default_rng(11).standard_normal((terms, rank)).astype(np.float32)

    weighted = test * weight[:, None]

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's share of (cells' transpose) (cells) (test matrix)."""
        # In doubles: a task adds up all its documents.
        total, seen = np.zeros((terms, rank)), False
        for batch in batches:
            for sizes, numbers in zip(batch.column("sizes").to_pylist(), batch.column("numbers").to_pylist()):
                own = _Rows(sizes, numbers, weight)
                if not len(own.term):
                    continue
                seen = True
                y = own.project(weighted)
                norm = np.maximum(1e-9, np.bincount(own.cell, weight[own.term] ** 2, own.cells))
                y /= norm.astype(np.float32)[:, None]
                order = np.argsort(own.term, kind="stable")
                term = own.term[order]
                start = np.flatnonzero(np.diff(term, prepend=-1))
                total[term[start]] += run_sums(y, own.cell[order], start)
        if not seen:
            return
        total *= weight[:, None]
        blocks = range(0, terms, TERM_BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int64()), pa.array([total[b : b + TERM_BLOCK].astype("<f4").tobytes() for b in blocks], pa.binary())],
            ["block", "part"],
        )

    parts = rows.select("sizes", "numbers").mapInArrow(spread, "block long, part binary")
    # As many numbers as the vocabulary and the rank make, whatever the corpus is.
    summed = {r["block"]: np.frombuffer(r["part"], np.float64) for r in _added(parts.select("block", shard, "part"), "<f4").collect()}
    image = np.concatenate([summed[b] for b in sorted(summed)]).reshape(terms, rank) if summed else np.zeros((terms, rank))
    of_items = np.zeros((terms, rank))
    for s in map(np.unique, items.sequences):
        of_items[s] += weighted[s].sum(0) / max(1e-9, float((weight[s] ** 2).sum()))
    of_items *= weight[:, None]
    image = sum(x / max(1e-9, float(np.linalg.norm(x))) for x in (image, of_items))
    left, size, _ = np.linalg.svd(image, full_matrices=False)
    # Directions below this are rounding.
    kept = min(RANK, max(1, int((size > 1e-4 * size[0]).sum())))
    basis = left[:, :kept].astype(np.float32)
    basis[0] = 0
    basis *= weight[:, None]
    query = np.array([basis[np.unique(s)].sum(0) for s in items.sequences], np.float32).reshape(len(items.ids), basis.shape[1])
    query /= np.maximum(1e-9, np.linalg.norm(query, axis=1))[:, None]

    sizes_of = np.array([len(s) for s in items.sequences], np.int64)
    scales, least = {}, 0
    for width, most in WIDTHS:
        scales[width] = np.flatnonzero((sizes_of > least) & (sizes_of <= most))
        least = most
    ends = [min(len(s), max(END_WORDS, round(END_SHARE * len(s)))) for s in items.sequences]
    wheres = [places(s) for s in items.sequences]
    end_wheres = [places(s[-n:]) for s, n in zip(items.sequences, ends)]

    def found_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [_Search(items.sequences, width, wanted, query) for width, wanted in scales.items() if len(wanted)]
        for batch in batches:
            for ids, sizes, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "sizes", "numbers"))):
                number, sizes = np.frombuffer(raw, np.uint32), np.asarray(sizes, np.int64)
                begin = np.cumsum(sizes) - sizes
                own_rows = _Rows(sizes, raw, weight)
                cells = own_rows.project(basis)
                found: dict[tuple[int, int], tuple[float, float, float]] = {}
                for search in searches:
                    passages = own_rows.passages(cells, search.width)
                    for doc, span, item in search.candidates(sizes, number, passages, terms, near):
                        own = number[begin[doc] : begin[doc] + sizes[doc]]
                        size, end_size, at = len(items.sequences[item]), ends[item], span * search.step
                        if lcs(wheres[item], size, own[max(0, at - search.reach) : at + search.far].tolist()) < PART * size:
                            continue
                        for at in range(at, min(at + search.step, max(1, len(own))), CELL):
                            stop = at + search.width * CELL
                            window = own[max(0, at - search.reach) : stop + search.reach].tolist()
                            share = lcs(wheres[item], size, window) / size
                            if share < PART:
                                continue
                            answer = lcs(end_wheres[item], end_size, window) / end_size
                            if share >= WHOLE or answer >= ANSWER:
                                cosine = float(passages[own_rows.first[doc] + at // CELL] @ query[item])
                                got = (share, answer, round(cosine, 4))
                                found[doc, item] = max(found.get((doc, item), got), got)
                keys = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, _ in keys], pa.int64()),
                        pa.array([items.ids[i] for _, i in keys], pa.int64()),
                        pa.array([found[k][2] for k in keys], pa.float64()),
                        pa.array([found[k][0] for k in keys], pa.float64()),
                        pa.array([found[k][1] for k in keys], pa.float64()),
                    ],
                    ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
                )

    leaks = rows.select("doc_ids", "sizes", "numbers").mapInArrow(
        found_in, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    )
    best = leaks.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"), F.max("answer_share").alias("answer_share")
    )
    return best.withColumn("kept", F.lit(False))
