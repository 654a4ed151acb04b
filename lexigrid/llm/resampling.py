"""Operator 11: importance resampling of documents towards a target distribution.

Every run of one to three words is a feature and falls into one of BUCKETS buckets
by its CRC-32.  Tasks write the buckets as packed uint16 streams, a block of whole
documents a row with the places where documents end.  Streams are sorted and
run-length encoded for the counts, of which there are at most BUCKETS a task; the
gain of a bucket is how much more the target holds of it.  A document's weight is
the sum of gains gathered along its stream, and weight plus Gumbel noise ranks the
documents, so that the best ranks are a draw without replacement.

The CRC of a run is put together from those of its words: with a table for each
length of the last word up to LONGEST, and by the library for longer words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import materialize
from .token_ids import slices

BUCKETS = 10_000
#: Words of a feature at most; words of a document that may be drawn, at least.
ORDER, MIN_WORDS = 3, 20
LONGEST = 64
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)

_WORD = np.zeros(256, bool)
_WORD[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = True


def _byte_table() -> np.ndarray:
    """The register after a byte, of a register that holds only the byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return t


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """Of each number of zero bytes, place of a byte in the register, and its value:
    the register after the zero bytes."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = np.empty((LONGEST + 1, 4, 256), np.uint32)
    for n in range(LONGEST + 1):
        out[n] = now
        now = _BYTE[now & np.uint32(255)] ^ (now >> np.uint32(8))
    return out.ravel()


_SHIFT = _shift_tables()


def _word_crcs(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word; words of one length and more go byte by byte together."""
    # Longest first, so that those with a k-th byte are in front.
    order = np.argsort((LONGEST + 1 - np.minimum(size, LONGEST + 1)).astype(np.uint8), kind="stable")
    at, sizes = first[order], size[order]
    crc = np.full(len(at), _ONES, np.uint32)
    begin = int(np.searchsorted(-sizes, -LONGEST))  # words of more than LONGEST bytes
    for k in range(LONGEST):
        end = int(np.searchsorted(-sizes[begin:], -k)) + begin
        if end == begin:
            break
        part = crc[begin:end]
        crc[begin:end] = _BYTE[(part ^ data[at[begin:end] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    crc ^= _ONES
    for k in range(begin):
        crc[k] = zlib.crc32(data[at[k] : at[k] + sizes[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _followed(crc: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """CRC-32 of what has ``crc``, a space, and the word at ``first``, whose is ``own``."""
    x = crc ^ _ONES
    x = (_BYTE[(x ^ np.uint32(0x20)) & np.uint32(255)] ^ (x >> np.uint32(8))) ^ _ONES
    base = np.minimum(size, LONGEST) * 1024
    out = own.copy()
    for k in range(4):
        out ^= _SHIFT[base + (256 * k) + ((x >> np.uint32(8 * k)) & np.uint32(255))]
    for k in np.flatnonzero(size > LONGEST).tolist():
        out[k] = zlib.crc32(data[first[k] : first[k] + size[k]], int(x[k]))
    return out


def bucket_stream(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts one after another, and each text's words.

    A text of n words has 3n - 3 features if n > 1.
    """
    raw = [v.encode("utf-8", "surrogatepass").lower() + b" " for v in values]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    edge = np.flatnonzero(np.diff(_WORD[data].view(np.int8), prepend=0, append=0))
    first, size = edge[0::2], edge[1::2] - edge[0::2]
    bounds = np.searchsorted(first, ends)
    words = np.diff(bounds, prepend=0)
    n = len(first)
    crc = np.zeros((n, ORDER), np.uint32)
    has = np.zeros((n, ORDER), bool)
    if n:
        place = np.arange(n) - np.repeat(bounds - words, words)
        crc[:, 0] = _word_crcs(data, first, size)
        has[:, 0] = True
        for k in range(1, ORDER):
            last = np.flatnonzero(place >= k)
            crc[last, k] = _followed(crc[last - 1, k - 1], data, first[last], size[last], crc[last, 0])
            has[last, k] = True
    return (crc[has] % np.uint32(BUCKETS)).astype(np.uint16), words


def _features(words: np.ndarray) -> np.ndarray:
    return np.sum([np.maximum(words - k, 0) for k in range(ORDER)], axis=0)


def streams(docs: DataFrame) -> DataFrame:
    """``ids, words, stream``: blocks of some documents, their ids, their numbers of
    words, from which the places where they end follow, and their buckets."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch):
                stream, words = bucket_stream(values)
                ids = batch.column("doc_id").slice(part.start, len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([words.tolist()], pa.list_(pa.int64())), pa.array([stream.astype("<u2").tobytes()], pa.binary())],
                    ["ids", "words", "stream"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "ids array<long>, words array<long>, stream binary")


def bucket_counts(blocks: DataFrame, name: str) -> DataFrame:
    """``bucket`` and how many features it has, from sorted streams."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for cell in batch.column("stream"):
                held = np.sort(np.frombuffer(cell.as_buffer(), "<u2"), kind="stable")
                start = np.flatnonzero(np.diff(held, prepend=held[:1] ^ 1)) if len(held) else np.zeros(0, np.int64)
                total[held[start]] += np.diff(start, append=len(held))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["bucket", "n"])

    runs = blocks.select("stream").mapInArrow(run, "bucket long, n long")
    return runs.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, of which there are BUCKETS, from ``bucket, s`` and
    ``bucket, t``."""
    zero = F.lit(0)
    both = source.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(source, "bucket", "left").join(target, "bucket", "left")
    rows = both.select("bucket", F.coalesce("s", zero).alias("s"), F.coalesce("t", zero).alias("t"))
    sums = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))

    def plus(name: str, n: int) -> Column:
        return F.col(name).cast("double") + n

    ratio = plus("t", 1) * plus("all_s", BUCKETS) / (plus("s", 1) * plus("all_t", BUCKETS))
    gains = np.zeros(BUCKETS, np.int64)
    # One row, joined to a fixed number of rows.
    for r in rows.join(F.broadcast(sums), F.lit(True)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        gains[r["bucket"]] = r["gain"]
    return gains


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document of the blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, cell in zip(batch.column("ids"), batch.column("words"), batch.column("stream")):
                n_words = words.values.to_numpy()
                features = _features(n_words)
                weight = np.zeros(len(features), np.int64)
                some = features > 0
                if some.any():
                    starts = (np.cumsum(features) - features)[some]
                    weight[some] = np.add.reduceat(sent.value[np.frombuffer(cell.as_buffer(), "<u2")], starts)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(n_words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"]
                )

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank``
    is 1, 2, ... of the drawn and null of the others.

    ``percent`` of the documents with MIN_WORDS words are drawn, by the highest
    scores, ties to the lesser id.  Null, empty and wordless texts have no features
    and the weight 0, so their score is noise alone; an empty ``docs`` gives an empty
    result, and an empty target gains that follow from its having nothing.  Repeated
    rows are drawn each; a null id comes after the others of its score, and its noise
    is that of ``<seed>:``.  Other columns are not read.
    """
    blocks = materialize(streams(docs), "streams")
    aimed = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gains = bucket_gains(bucket_counts(blocks, "s"), bucket_counts(aimed, "t"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # The row's place tells repeated rows apart, so that they can be ranked in ranges.
    scored = weights(blocks, gains).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "scores")
    eligible = F.col("n_words") >= MIN_WORDS
    drawn = percent * scored.where(eligible).count() // 100
    ranked = numbered(scored.where(eligible), "rank", F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"), start=1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
