"""Embedders, and vectors cached by content hash."""

from __future__ import annotations

import hashlib
import json
import ssl
import time
import urllib.request
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str
    batch: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashEmbedder:
    """Offline and deterministic: hashed words, signed, of unit length."""

    model: str = "hash-64"
    dim: int = 64
    batch: int = 256

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        # Each different word of a batch is hashed once.
        known: dict[str, int] = {}
        for text in texts:
            words = Counter(text.lower().split())
            for word in words:
                if word not in known:
                    known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            h = np.fromiter((known[word] for word in words), np.uint64, len(words))
            n = np.fromiter(words.values(), np.float64, len(words))
            v = np.bincount((h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), n, -n), self.dim)
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist())
        return out


def post(url: str, body: dict, api_key: str = "", timeout: int | None = 300, verify: bool = True, ca_bundle: str = ""):
    """The open answer of a service to a JSON request; no timeout of 0 or None."""
    headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {api_key}"} if api_key else {})}
    context = ssl.create_default_context(cafile=ca_bundle or None) if url.startswith("https") else None
    if context and not verify:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    return urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout or None, context=context)


@dataclass
class EndpointEmbedder:
    """An embeddings service; rows come back by their ``index``."""

    url: str
    model: str
    api_key: str = ""
    batch: int = 64
    timeout: int = 300
    verify: bool = True
    ca_bundle: str = ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        with post(self.url, {"model": self.model, "input": texts}, self.api_key, self.timeout, self.verify, self.ca_bundle) as answer:
            rows = json.load(answer)["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


def embed_list(texts: list[str], embedder: Embedder, on_batch: Callable[[int, list[list[float]]], None] | None = None) -> list[list[float]]:
    """Unit vectors of a few texts, batch by batch; ``on_batch`` is told the place of
    each batch and its vectors."""
    if embedder.batch < 1:
        raise ValueError("a batch holds at least one text")
    out: list[list[float]] = []
    for start in range(0, len(texts), embedder.batch):
        vectors = np.array(embedder.embed(texts[start : start + embedder.batch]), np.float64)
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        part = (vectors / np.where(size == 0, 1.0, size)).astype(np.float32).tolist()
        out += part
        if on_batch:
            on_batch(start, part)
    return out


def embed(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """``hash, model, vector`` of ``texts(hash, text)``, batch by batch."""
    if embedder.batch < 1:
        raise ValueError("a batch holds at least one text")

    # Only one batch of the embedder at a time is more than a view of what Spark sends.
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), embedder.batch):
                part = whole.slice(start, embedder.batch)
                vectors = np.array(embedder.embed(part.column("text").to_pylist()), np.float64)
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = (vectors / np.where(size == 0, 1.0, size)).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * vectors.shape[1], pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("hash"), pa.array([embedder.model] * len(part)), lists], ["hash", "model", "vector"])

    return texts.select("hash", "text").mapInArrow(run, "hash string, model string, vector array<float>")


def text_hash(text: str = "text"):
    return F.sha2(F.col(text).cast("binary"), 256)


def cache_hits(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts whose vector is known, with it."""
    return texts.join(cache.where(F.col("model") == model).select("hash", "vector"), "hash")


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts whose vector is not known."""
    return texts.join(cache.where(F.col("model") == model).select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def cache_upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with new rows; of several for a key the one of highest ``seq``."""
    both = cache.unionByName(rows)
    last = Window.partitionBy("hash", "model").orderBy(F.desc("seq"))
    return both.withColumn("_row", F.row_number().over(last)).where("_row = 1").drop("_row")


def embed_all(texts: DataFrame, cache: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Vectors for every row of ``texts(pos, hash, text)``, and new cache rows."""
    fresh = embed(cache_misses(texts, cache, embedder.model), embedder)
    known = cache.where(F.col("model") == embedder.model).select("hash", "model", "vector").unionByName(fresh)
    return texts.join(known.select("hash", "vector"), "hash"), fresh


#: Bytes of texts that a task can read of a commit, so that all tasks share it.
SPLIT_BYTES = 4 << 20

#: A commit of no more texts is one task, and a job makes a round of such commits.
TASK_TEXTS = 1_000
#: Texts of a round, about.
ROUND_TEXTS = 100_000


class VectorCache:
    """Vectors by hash and model in a folder; what is added is there at once, so an
    interrupted run goes on where it stopped."""

    def __init__(self, spark: SparkSession, root: str, rows_per_commit: int = 100_000):
        self.spark, self.root, self.rows_per_commit = spark, root.rstrip("/"), rows_per_commit

    def _folder(self, model: str) -> str:
        return f"{self.root}/{hashlib.sha256(model.encode()).hexdigest()[:16]}"

    def rows(self, model: str) -> DataFrame:
        """``hash, model, vector`` of a model, one row a hash: the one added last."""
        schema = "hash string, model string, vector array<float>, seq long"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(model))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema).drop("seq")
        held = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self._folder(model))
        last = F.max_by("vector", F.coalesce("seq", F.lit(0)))
        return held.where(F.col("model") == model).groupBy("hash").agg(F.lit(model).alias("model"), last.alias("vector"))

    def add(self, model: str, vectors: DataFrame) -> None:
        """Commit ``hash, model, vector``, which count from now on; what a task wrote
        does so when the task ends, and stays if others fail."""
        rows = vectors.withColumn("seq", F.lit(time.time_ns()))
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self._folder(model)}/{uuid.uuid4().hex}")

    def fill(self, texts: DataFrame, embedder: Embedder, on_commit: Callable[[int, int], None] | None = None) -> DataFrame:
        """Vectors of all of ``texts(hash, text)``, in commits of about
        ``rows_per_commit``; ``on_commit`` is told how many are done and there are.

        Small commits are made in rounds of 1, 2, 4 and more, so that an embedder that
        fails does so early."""
        from .scratch import fresh_path, materialize

        missing = materialize(cache_misses(texts.select("hash", "text"), self.rows(embedder.model), embedder.model), "missing")
        parts = -(-missing.count() // self.rows_per_commit)
        doublings = (ROUND_TEXTS // self.rows_per_commit).bit_length() - 1 if self.rows_per_commit <= TASK_TEXTS else 0
        if parts > 1:
            # Dealt once, so that a round reads its own texts only.
            folder = fresh_path(self.spark, "missing-parts")
            part = F.pmod(F.xxhash64("hash"), F.lit(parts)).cast("int")
            nth = F.col("part") + 1
            round_ = F.when(nth < 2 << doublings, F.length(F.bin(nth)) - 1).otherwise(F.shiftright(nth, doublings) - 1 + doublings)
            dealt = missing.select("hash", "text", part.alias("part")).withColumn("round", round_)
            dealt.hint("rebalance", "round").write.option("parquet.block.size", SPLIT_BYTES).partitionBy("round").parquet(folder)
        done = k = 0
        while done < parts:
            commits = min(1 << min(k, doublings), parts - done)
            if parts > 1:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/round={k}")
                held = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
                missing = self.spark.read.schema("hash string, text string, part int").parquet(f"{folder}/round={k}") if held else None
            if missing is not None:
                if commits > 1:
                    missing = missing.repartitionById(commits, F.col("part") - done)
                self.add(embedder.model, embed(missing, embedder))
            for _ in range(commits):
                done += 1
                if on_commit:
                    on_commit(done, parts)
            k += 1
        return self.rows(embedder.model).join(texts.select("hash").distinct(), "hash", "left_semi")
