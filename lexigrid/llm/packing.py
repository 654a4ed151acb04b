"""Operator 8: shortest-pack-first packing over the length histogram.

Documents are cut into pieces of at most ``size`` tokens.  The histogram of
piece lengths, which has ``size`` entries whatever the corpus, is packed on the
driver: lengths are placed longest first, each into the pattern with most room
left, and a pattern counts how many sequences look alike.  Pieces then find
their sequence by the rank of the piece among those of its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts
from .token_ids import encoded

#: Rows of runs of the packing that are sent to every task; more are joined by a shuffle.
MOST_RUNS = 100_000

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, task int, nth long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 4096) -> DataFrame:
    """Pieces of all documents: full ones of ``size`` tokens and the rest.

    ``task`` and ``nth`` number the pieces of a length; they hold for one
    evaluation, so :func:`place` writes them before it uses them.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for rows, ids, ends in encoded(batches, tokenizer_path, end_id):
            total = np.diff(ends, prepend=0)
            begin = ends - total
            pieces = -(-total // size)
            owner = np.repeat(np.arange(len(total)), pieces)
            start = size * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            length = np.minimum(size, total[owner] - start)
            raw, at = ids.astype("<u4").tobytes(), 4 * (begin[owner] + start)
            order = np.argsort(length, kind="stable")
            run_of = length[order]
            within = np.arange(len(order)) - np.searchsorted(run_of, run_of, "left")
            nth = np.empty(len(order), np.int64)
            nth[order] = within + seen[run_of]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(owner)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([raw[a : a + 4 * n] for a, n in zip(at.tolist(), length.tolist())], pa.binary()),
                    pa.array(total[owner]),
                    pa.array(np.full(len(owner), task, np.int32)),
                    pa.array(nth),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "task", "nth"],
            )

    return texts(docs).mapInArrow(run, _PIECES)


def _packs(counts: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (number of sequences, (length, how often in a row) in order),
    shortest pack first."""
    open_packs: list[tuple[int, int, int, tuple[tuple[int, int], ...]]] = []  # (tokens, tie, count, lengths)
    full: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    tie = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_packs and open_packs[0][0] + length <= size:
                used, _, many, lengths = heapq.heappop(open_packs)
                # A pattern takes the length as often as it fits, if there are
                # enough pieces for all its sequences.
                fits = max(1, min((size - used) // length, left // many))
                taken = min(many, left)
                if taken < many:
                    tie += 1
                    heapq.heappush(open_packs, (used, tie, many - taken, lengths))
                    fits = 1
                # Shortest first: only as often as it stays the shortest.
                if open_packs:
                    fits = min(fits, max(1, (open_packs[0][0] - used) // length))
            else:
                used, lengths, taken, fits = 0, (), left, 1
            left -= taken * fits
            used += fits * length
            # A length that follows itself is one entry: short ones may come thousands of times.
            if lengths and lengths[-1][0] == length:
                lengths = (*lengths[:-1], (length, lengths[-1][1] + fits))
            else:
                lengths = (*lengths, (length, fits))
            if used == size:
                full.append((taken, lengths))
            else:
                tie += 1
                heapq.heappush(open_packs, (used, tie, taken, lengths))
    return full + [(many, lengths) for _, _, many, lengths in sorted(open_packs)]


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns as (number of sequences, lengths in order), shortest pack first."""
    return [(many, [n for n, k in lengths for _ in range(k)]) for many, lengths in _packs(counts, size)]


def _runs(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequences, first sequence, offset):
    ranks go through a run's sequences, and then through them again one length on."""
    rank: dict[int, int] = {}
    runs, sequence = [], 0
    for many, lengths in patterns:
        offset = 0
        for length, fits in lengths:
            at = rank.get(length, 0)
            runs.append((length, at, at + many * fits, many, sequence, offset))
            rank[length] = at + many * fits
            offset += length * fits
        sequence += many
    return runs


def _blocks(runs: list[tuple[int, int, int, int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(length, ranks of a block), and the runs with each block that they reach into.

    A length has as many blocks as runs at most, so a rank meets the few runs of its
    block, not all of its length: together they make at most twice as many rows.
    """
    of: dict[int, tuple[int, int]] = {}
    for length, _, high, *_ in runs:
        of[length] = of.get(length, (0, 0))[0] + 1, high
    steps = {length: -(-ranks // many) for length, (many, ranks) in of.items()}
    dealt = [(r[0], k, *r[1:]) for r in runs for k in range(r[1] // steps[r[0]], (r[2] - 1) // steps[r[0]] + 1)]
    return list(steps.items()), dealt


def place(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces from :func:`cut_pieces`.

    Every piece is placed once; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    counts = pieces.groupBy("task", "length").agg(F.max("nth").alias("last"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(F.col("last") + 1).alias("n")).collect()}
    steps, dealt = _blocks(_runs(_packs(histogram, size)))
    # The patterns come from a histogram of at most `size` lengths, so these tables
    # stay small whatever the corpus is; that is checked.
    table = spark.createDataFrame(dealt, "of_length int, of_block int, low long, high long, sequences long, first_sequence long, first_offset long")
    step = spark.createDataFrame(steps, "length long, step long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        "task", "length", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base")
    ).join(F.broadcast(step), "length")
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.withColumn("block", F.expr("CAST(rank DIV step AS int)"))
    t = F.broadcast(table) if len(dealt) <= MOST_RUNS else table
    of_run = (F.col("length").cast("int") == F.col("of_length")) & (F.col("block") == F.col("of_block"))
    found = ranked.join(t, of_run & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    found = found.withColumn("offset", F.col("first_offset") + F.expr("(rank - low) DIV sequences") * F.col("length"))
    return found.withColumn("sequence_id", F.col("first_sequence") + at % F.col("sequences")).drop(
        "task", "nth", "base", "step", "rank", "block", "of_length", "of_block", "low", "high", "sequences", "first_sequence", "first_offset"
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 4096) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` per piece.

    A null or empty text is one piece, its end token; a null ``doc_id`` is kept;
    repeated rows are packed each; other columns are not read.  Which of equally long
    pieces goes to which of their places follows their order in the table's files.
    """
    return place(cut_pieces(docs, tokenizer_path, end_id, size), size)
