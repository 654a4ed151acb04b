"""Incremental ingest of a document stream into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, embedder=None, size: int = 1200, overlap: int = 200) -> StreamingQuery:
    """Upsert every batch of ``stream(path, sha256, text)`` by content hash.

    A batch that runs again after a failure finds its hashes in the store and
    changes nothing, so each document is stored once.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch, embedder, size, overlap)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
