"""Operator 6: token ids in Simple-8b files, ascending by document.

A file is a Parquet table whose rows are blocks of whole documents::

    bucket int, block int, first long, n_ids long,
    doc_ids array<long>, id_counts array<long>, word_counts array<long>,
    words binary

``bucket`` numbers ranges of ``doc_id`` in ascending order, ``block`` counts
within a bucket, ``first`` is the number of ids of the bucket before the block,
``words`` holds little-endian 64-bit Simple-8b words.  Every document starts a
word, so ``word_counts`` gives each document's place in the block.  Parquet is
the container because Spark's committer then makes the write safe against lost
executors on any file system.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import texts
from .token_ids import encoded

#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 16

_BLOCKS = (
    "bucket int, block int, first long, n_ids long, doc_ids array<long>, "
    "id_counts array<long>, word_counts array<long>, words binary"
)


def _range_bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 bounds of ranges of about as many documents."""
    probabilities = [k / n for k in range(1, n)]
    if not probabilities:
        return []
    row = docs.select(F.percentile_approx("doc_id", probabilities, 20 * n).alias("q")).first()
    return sorted(set(row["q"] or []))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every whole text and write the files under ``path``.

    A null or empty text is just ``end_id``; documents with a null ``doc_id``
    come first; rows that share a ``doc_id`` are all kept, in the order of their
    coded bytes; an empty table gives files without blocks; other columns are not
    read.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = texts(docs)
    bounds = _range_bounds(source, n)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, ends in encoded(batches, tokenizer_path, end_id):
            words, sizes = simple8b.encode(ids, ends)
            raw, at = words.astype("<u8").tobytes(), 8 * np.concatenate(([0], np.cumsum(sizes)))
            doc = rows.column("doc_id").to_pylist()
            known = np.array([-(1 << 63) if d is None else d for d in doc], np.int64)
            bucket = np.searchsorted(np.array(bounds, np.int64), known, "left")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket.astype(np.int32)),
                    rows.column("doc_id"),
                    pa.array(np.diff(ends, prepend=0)),
                    pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary()),
                ],
                ["bucket", "doc_id", "n_ids", "words"],
            )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "block", "first", "n_ids", "doc_ids", "id_counts", "word_counts", "words"]
        bucket, block, first, held, room = None, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            cells = [
                bucket, block, first, room, [h[0] for h in held], [h[1] for h in held],
                [len(h[2]) // 8 for h in held], b"".join(h[2] for h in held),
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names)

        for batch in batches:
            for b, d, n_ids, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n_ids", "words"))):
                if held and (b != bucket or room + n_ids > BLOCK_IDS):
                    yield close()
                    block, first, held, room = block + 1, first + room, [], 0
                if b != bucket:
                    bucket, block, first = b, 0, 0
                held.append((d, n_ids, words))
                room += n_ids
        if held:
            yield close()

    coded = source.mapInArrow(code, "bucket int, doc_id long, n_ids long, words binary")
    (
        coded.repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("bucket", "doc_id", "n_ids", "words")
        .mapInArrow(pack, _BLOCKS)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``ids`` are little-endian
    unsigned 32-bit integers, ``start`` counts the ids of all documents before.
    """
    files = spark.read.schema(_BLOCKS).parquet(path)
    # One number a bucket, and as many buckets as shuffle partitions.
    totals = files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()
    base, before = {}, 0
    for row in sorted(totals):
        base[row["bucket"]], before = before, before + row["n"]

    def open_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(np.frombuffer(row["words"], "<u8")).astype("<u4")
                ends = np.cumsum(row["id_counts"])
                start = base[row["bucket"]] + row["first"] + ends - row["id_counts"]
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(row["id_counts"], pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(ends - row["id_counts"], ends)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return files.mapInArrow(open_blocks, "doc_id long, start long, n_tokens long, ids binary")
