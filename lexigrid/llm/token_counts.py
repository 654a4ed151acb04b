"""Operator 5: token counts by a compiled finite-state transducer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .token_ids import slices

_compiled: dict = {}


def transducer(path: str):
    """One transducer a worker process, compiled further as words come."""
    from .wordpiece_fst import Transducer

    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text.

    Null and empty texts have 0 bytes and 0 tokens; a text of any length is
    counted whole; repeated rows are counted each; an empty table gives an empty
    result; a null ``doc_id`` is kept; other columns are not read.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = transducer(tokenizer_path).counts
        for batch in batches:
            n = [x for _, part in slices(batch, size=1 << 19) for x in count(part).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    source = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
