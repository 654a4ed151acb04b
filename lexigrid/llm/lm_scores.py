"""Operator 9: stupid-backoff scores from n-gram count tables.

Documents are gathered into chunks, which are written once so that a chunk stays
the same however often a task runs.  A chunk explodes its texts into n-grams of every order, combines equal ones, and sends each count table
partition the sorted hashes that fall into it.  A partition adds the counts of
all chunks and answers every chunk with the totals in the chunk's order; the
chunk joins them to its n-grams and sums the scores of each document.  An n-gram
travels once a chunk however often it occurs, so a frequent one heats nothing.

Every n-gram of a document is in tables that are made from it too.  So documents are
also scored by the tables less their own n-grams, where stepping back matters.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts
from .token_ids import slices
from .words import POWER, mix, word_hashes

#: Highest order, the factor of one step back, and the count of a word that nothing
#: else holds.
ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5
#: Bytes of text of a chunk, and for each partition of the tables.
CHUNK_BYTES, PART_BYTES = 4 << 20, 10 << 20
#: Most bits of a hash within its partition; the rest chooses the partition.
MOST_BITS = 46


def _grams(word: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each word, by order, and whether the text
    has that many words yet."""
    starts = np.concatenate(([0], bounds[:-1]))
    place = np.arange(len(word)) - np.repeat(starts, np.diff(bounds, prepend=0))
    hashes, known, rolling = [], [], np.zeros(len(word), np.uint64)
    for n in range(1, order + 1):
        shifted = np.zeros(len(word), np.uint64)
        shifted[n - 1 :] = word[: max(0, len(word) - n + 1)]
        rolling = rolling + shifted * _power(n)
        hashes.append(mix(rolling + np.uint64(n)))
        known.append(place >= n - 1)
    return np.concatenate(hashes), np.concatenate(known)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(POWER), n, 1 << 64))


def _bits(parts: int) -> int:
    """Bits of a hash within one of ``parts`` partitions."""
    return min(MOST_BITS, 64 - (parts - 1).bit_length())


def _placed(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition and hash within it, in one number; the upper bits choose the partition."""
    bits = _bits(parts)
    return ((h >> np.uint64(bits)) % np.uint64(parts)) << np.uint64(bits) | (h & np.uint64((1 << bits) - 1))


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """``chunk, words, doc_ids, sizes, packed``: number of words, ids, byte lengths
    and compressed texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        held_ids: list[int | None] = []
        held: list[bytes] = []
        room = 0

        def close() -> pa.RecordBatch:
            cells = [secrets.randbits(63), sum(len(r.split()) for r in held), held_ids, [len(r) for r in held], pack.compress(b"".join(held))]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["chunk", "words", "doc_ids", "sizes", "packed"])

        for batch in batches:
            for part, values in slices(batch, size=1 << 19):
                held_ids += batch.column("doc_id").slice(part.start, len(values)).to_pylist()
                held += [v.encode("utf-8", "surrogatepass") for v in values]
                room += sum(map(len, held[len(held) - len(values) :]))
                if room >= size:
                    yield close()
                    held_ids, held, room = [], [], 0
        if held:
            yield close()

    return docs.mapInArrow(run, "chunk long, words long, doc_ids array<long>, sizes array<long>, packed binary")


def _opened(sizes: np.ndarray, packed: bytes) -> list[str]:
    whole, at = zstandard.ZstdDecompressor().decompress(packed), 0
    out = []
    for n in sizes.tolist():
        out.append(whole[at : at + n].decode("utf-8", "surrogatepass"))
        at += n
    return out


def _chunk_grams(values: list[str], parts: int, order: int):
    word, bounds = word_hashes(values)
    whole, known = _grams(word, bounds, order)
    return word, bounds, known, _placed(whole[known], parts)


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences: 32 low bits plain, the others, which
    are few and alike, compressed."""
    steps = np.diff(values, prepend=values[:1])
    high = (steps >> np.uint64(32)).astype("<u4")
    kind = "<u1" if not len(high) or high.max() < 256 else "<u4"
    rest = zstandard.ZstdCompressor(level=1).compress(high.astype(kind).tobytes())
    low = (steps & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
    return kind[-1].encode() + len(steps).to_bytes(8, "little") + values[:1].astype("<u8").tobytes() + low + rest


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[1:9], "little")
    if not n:
        return np.zeros(0, np.uint64)
    steps = np.frombuffer(raw, "<u4", n, 17).astype(np.uint64)
    high = zstandard.ZstdDecompressor().decompress(raw[17 + 4 * n :])
    steps |= np.frombuffer(high, "<u1" if raw[:1] == b"1" else "<u4").astype(np.uint64) << np.uint64(32)
    return np.frombuffer(raw, "<u8", 1, 9) + np.cumsum(steps, dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    kind = "<u1" if not len(counts) or counts.max() < 256 else "<u8"
    return kind[-1].encode() + zstandard.ZstdCompressor(level=1).compress(counts.astype(kind).tobytes())


def _unsmall(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), "<u1" if raw[:1] == b"1" else "<u8").astype(np.int64)


def _word_scores(counts: np.ndarray, whole: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """The logarithm of each word's score from the counts of the n-grams that end
    there, by order, in tables of ``whole`` words."""
    with np.errstate(divide="ignore", invalid="ignore"):
        # A text's first words have no longer n-gram to step back from.
        most = np.minimum(order - 1, place)
        score = np.log10(np.maximum(counts[0], UNSEEN) / whole) + most * np.log10(BACKOFF)
        for k in range(1, order):
            before = np.concatenate(([0.0], counts[k - 1][:-1]))
            held = counts[k] > 0
            score[held] = (np.log10(counts[k]) - np.log10(before) + (most - k) * np.log10(BACKOFF))[held]
    return score


def _sums(score: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(score)))
    return sums[bounds] - sums[starts]


def score(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score, held_out_score``.

    ``log_score`` sums the decimal logarithms of the words' scores by the tables of
    all documents: the relative frequency of the longest n-gram that the tables hold,
    times the backoff factor for every step back; ``mean_log_score`` is that a word.
    ``held_out_score`` is the mean by the tables less the document's own n-grams, so
    that a document does not vouch for itself; a word of no other document counts
    UNSEEN times.  Null, empty and wordless texts have 0 words, score 0 and null
    means; null ids and repeated rows are scored each, and a repeated row vouches for
    its like; an empty table gives an empty result; other columns are not read.
    """
    chunked = materialize(chunks(texts(docs), chunk_bytes), "chunks")
    room, whole = chunked.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)), F.sum("words")).first()
    room, whole = room or 0, max(1, whole or 0)
    parts = 1 + room // part_bytes

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                values = _opened(np.array(batch.column("sizes")[k].as_py(), np.int64), batch.column("packed")[k].as_py())
                _, _, _, placed = _chunk_grams(values, parts, order)
                unique, counts = np.unique(placed, return_counts=True)
                part = (unique >> np.uint64(_bits(parts))).astype(np.int64)
                first = np.flatnonzero(np.diff(part, prepend=-1))
                blocks = list(zip(first.tolist(), np.append(first[1:], len(part)).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("chunk")[k].as_py()] * len(blocks), pa.int64()),
                        pa.array(part[first]),
                        pa.array([_pack(unique[a:b]) for a, b in blocks], pa.binary()),
                        pa.array([_small(counts[a:b]) for a, b in blocks], pa.binary()),
                    ],
                    ["chunk", "part", "hashes", "counts"],
                )

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "hashes", "counts"))):
                held.setdefault(part, []).append(tuple(row))
        for part, rows in held.items():
            hashes = [_unpack(raw) for _, raw, _ in rows]
            counts = np.concatenate([_unsmall(raw) for _, _, raw in rows])
            unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)[inverse]
            ends = np.cumsum([len(h) for h in hashes])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk for chunk, _, _ in rows], pa.int64()), pa.array(np.full(len(rows), part, np.int64)),
                    pa.array([_small(t) for t in np.split(totals, ends[:-1])], pa.binary()),
                ],
                ["chunk", "part", "totals"],
            )

    def join(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        word, bounds, known, placed = _chunk_grams(_opened(row["sizes"], row["packed"]), parts, order)
        answers = answers.sort_values("part")
        totals = np.concatenate([_unsmall(raw) for raw in answers["totals"]]) if len(answers) else np.zeros(0, np.int64)
        n = len(word)
        starts = np.concatenate(([0], bounds[:-1]))
        size = bounds - starts
        owner = np.repeat(np.arange(len(bounds)), size)
        place = np.arange(n) - starts[owner]
        gram = np.unique(placed, return_inverse=True)[1]
        counts, own = np.zeros(len(known)), np.zeros(len(known))
        counts[known] = totals[gram]
        # How often the document itself has each of its n-grams.
        pair, times = np.unique(np.tile(owner, order)[known] * (len(totals) + 1) + gram, return_inverse=True, return_counts=True)[1:]
        own[known] = times[pair]
        counts, own = counts.reshape(order, n), own.reshape(order, n)
        log = np.round(_sums(_word_scores(counts, np.full(n, whole), place, order), bounds, starts), 6)
        rest = np.maximum(1, whole - size)[owner]
        held_out = _sums(_word_scores(counts - own, rest, place, order), bounds, starts)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(d) else int(d) for d in row["doc_ids"]], "Int64"),
                "n_words": size,
                "log_score": log,
                "mean_log_score": np.where(size > 0, np.round(log / np.maximum(size, 1), 6), np.nan),
                "held_out_score": np.where(size > 0, np.round(held_out / np.maximum(size, 1), 6), np.nan),
            }
        )

    requests = chunked.select("chunk", "sizes", "packed").mapInArrow(count, "chunk long, part long, hashes binary, counts binary")
    # One partition of the tables a task.
    answers = requests.repartitionById(parts, F.col("part").cast("int")).mapInArrow(total, "chunk long, part long, totals binary")
    scored = (
        chunked.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(join, "doc_id long, n_words long, log_score double, mean_log_score double, held_out_score double")
    )
    return scored.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("mean_log_score", "held_out_score")})
