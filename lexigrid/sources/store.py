"""A document store: layers of rows in buckets of paths, and numbered versions of them.

A write adds a layer: the rows of its own documents, and for those that it replaces or
removes rows of ``gone``, which say that rows of a path from before are dead.  So what
is written grows with the batch, not with the store.  Each row carries the number of
the write, ``seq``; a row is live unless a later write names its path in ``gone``.
Layers of like size are merged (:meth:`Store.compact`), so that a row is written again
a logarithmic number of times and a bucket has few layers.

A write publishes a version, a small file that names each bucket's layers, in one
rename.  Versions are numbered and the greatest counts, so readers see one version or
the other, a write that fails anywhere changes nothing, and older versions can be read
until they are removed.  Two writers that start from one version both succeed if they
change different buckets; else the second fails with :class:`.versions.Conflict`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .scratch import materialize
from .versions import Conflict, Taken, Versions

DOCUMENTS = "path string, sha256 string, chunks int, added_at timestamp"
CHUNKS = "path string, ord int, text string, vec array<float>"
GONE = "path string, below long"
#: Buckets of a new store.
BUCKETS = 32
#: Layers of a bucket from which on a write merges some of them.
LAYERS = 8
#: An older layer is merged if it has at most so many times the rows of the newer ones.
TIER = 2


def with_status(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming(path, sha256, ...)`` with ``status``: new, changed or unchanged.

    Paths that are only in the store stay as they are, and are not listed.
    """
    old = stored.select("path", F.col("sha256").alias("stored_sha256"), F.lit(True).alias("is_stored"))
    status = F.when(F.col("is_stored").isNull(), "new").when(F.col("stored_sha256").eqNullSafe(F.col("sha256")), "unchanged").otherwise("changed")
    return incoming.join(old, "path", "left").withColumn("status", status).drop("stored_sha256", "is_stored")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Old rows whose key is not new, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def matches(path: Column, pattern: str) -> Column:
    """The store's forget pattern: case-insensitive LIKE on any part, unescaped."""
    return path.ilike("%" + pattern.replace("\\", "\\\\") + "%")


def chunk_rows(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """``path, ord, text`` of every chunk."""
    return docs.select("path", F.posexplode(T.chunk(F.col("text"), size, overlap)).alias("ord", "text"))


def listed(documents: DataFrame) -> DataFrame:
    """``path, chunks, line``: one line a document, by path."""
    line = F.format_string("%5d chunks  %s  %s", "chunks", F.date_format("added_at", "yyyy-MM-dd HH:mm"), "path")
    return documents.orderBy("path").select("path", "chunks", line.alias("line"))


class Store(Versions):
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        super().__init__(spark, root)
        self._buckets = buckets

    # Versions

    def _manifest(self, number: int | None = None) -> dict:
        """What a version holds: layers of each bucket, oldest first, the version in
        which its content changed last, the number of buckets, and vectors' size."""
        number = self.version() if number is None else number
        if not number:
            return {"buckets": self._buckets, "folders": {}, "changed": {}, "dim": None}
        held = self._content(number)
        # Stores from before layers have one folder a bucket.
        folders = {b: [{"folder": x, "rows": 1, "gone": 0}] if isinstance(x, str) else x for b, x in held["folders"].items()}
        return {"changed": {}, **held, "folders": folders}

    def _publish_change(self, change: Callable[[dict, int], dict]) -> int:
        """Publish ``change(manifest, number)`` of the newest version as ``number``,
        again on top of what other writes have published meanwhile."""
        while True:
            number = self.version() or 0
            try:
                self._publish(number + 1, change(self._manifest(number), number + 1))
                return number + 1
            except Taken:
                continue

    def clean(self, keep: int = 1) -> int:
        """Remove all but the newest ``keep`` versions and folders that only they or
        failed writes used; how many folders.  No write may run meanwhile."""
        fs, numbers = self._fs(), self.versions()
        used = {x["folder"] for n in numbers[-keep:] for layers in self._manifest(n)["folders"].values() for x in layers}
        for n in numbers[:-keep]:
            fs.delete(self._path(f"versions/{n:012d}"), False)
        there = [f.getPath().getName() for f in fs.listStatus(self._path("data"))] if fs.exists(self._path("data")) else []
        gone = [name for name in there if name not in used]
        for name in gone:
            fs.delete(self._path(f"data/{name}"), True)
        return len(gone)

    # Tables

    def _scan(self, table: str, schema: str, layers: Iterable[tuple[str, dict]]) -> DataFrame:
        """Rows of a table in ``(bucket, layer)``, with their bucket."""
        paths = [f"{self.root}/data/{x['folder']}/{table}/bucket={b}" for b, x in layers if x["gone" if table == "gone" else "rows"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _live(self, table: str, schema: str, layers: list[tuple[str, dict]]) -> DataFrame:
        """Rows of a table, with ``seq``, that no later write has replaced or removed."""
        rows = self._scan(table, f"{schema}, seq long", layers).withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))
        if not any(x["gone"] for _, x in layers):
            return rows
        gone = self._scan("gone", GONE, layers).select(F.col("path").alias("gone_path"), "below")
        return rows.join(gone, (F.col("path") == F.col("gone_path")) & (F.col("seq") < F.col("below")), "left_anti")

    def _read(self, table: str, schema: str, buckets: list[int] | None, version: int | None) -> DataFrame:
        if version and version not in self.versions():
            raise ValueError(f"there is no version {version} of {self.root}")
        folders = self._manifest(version)["folders"]
        layers = [(b, x) for b in sorted(folders) if buckets is None or int(b) in buckets for x in folders[b]]
        return self._live(table, schema, layers).drop("seq")

    def documents(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """Documents of the newest or a given version; version 0 is the empty store."""
        return self._read("documents", DOCUMENTS, buckets, version)

    def chunks(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        return self._read("chunks", CHUNKS, buckets, version)

    def chunks_of(self, paths: list[str], version: int | None = None) -> DataFrame:
        """Chunks of some documents; only the buckets of their paths are read."""
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        buckets = [r[0] for r in named.select(self._bucket(self._manifest(version)["buckets"])).distinct().collect()]
        return self.chunks(buckets, version).where(F.col("path").isin(paths))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")

    def _write(self, folder: str, table: str, rows: DataFrame) -> dict[str, int]:
        """Write rows with their bucket; the number of rows of each."""
        path = f"{self.root}/data/{folder}/{table}"
        # Spark splits what is too large for one task.
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        written = self.spark.read.schema("path string, bucket int").parquet(path)
        return {str(r["bucket"]): r["count"] for r in written.groupBy("bucket").count().collect()}

    def _commit(self, base: int, documents: DataFrame | None, chunks: DataFrame | None, gone: DataFrame) -> int:
        """Add a layer to what version ``base`` holds: rows of documents and chunks,
        and paths whose rows from before are dead."""
        manifest, folder, seq = self._manifest(base), uuid.uuid4().hex, F.lit(base + 1).cast("long")
        bucket = self._bucket(manifest["buckets"])
        held, dims = {}, set()
        if documents is not None and chunks is not None:
            for name, rows, schema in (("chunks", chunks, CHUNKS), ("documents", documents, DOCUMENTS)):
                held = self._write(folder, name, rows.select(*(c.split()[0] for c in schema.split(", ")), seq.alias("seq"), bucket))
            written = self.spark.read.schema(f"{CHUNKS}, bucket int").parquet(f"{self.root}/data/{folder}/chunks")
            dims = set(written.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()) - {None}
        dead = self._write(folder, "gone", gone.select("path", seq.alias("below"), bucket))

        def change(now: dict, number: int) -> dict:
            taken = [b for b in {*held, *dead} if now["changed"].get(b, 0) > base]
            if taken:
                raise Conflict(f"another write changed buckets {sorted(map(int, taken))} of {self.root}")
            sizes = dims | ({now["dim"]} - {None})
            if len(sizes) > 1:
                raise ValueError(f"vectors of {sorted(sizes)} numbers do not go into one store")
            folders, changed = dict(now["folders"]), dict(now["changed"])
            for b in {*held, *dead}:
                folders[b] = [*folders.get(b, []), {"folder": folder, "rows": held.get(b, 0), "gone": dead.get(b, 0)}]
                changed[b] = number
            return {"buckets": now["buckets"], "folders": folders, "changed": changed, "dim": next(iter(sizes), None)}

        number = self._publish_change(change)
        if any(len(layers) > LAYERS for layers in self._manifest(number)["folders"].values()):
            self.compact()
        return number

    def compact(self, whole: bool = False) -> int:
        """Merge layers of buckets; how many buckets.

        From the newest layer on those are merged that have at most ``TIER`` times the
        rows of the newer ones together, or all with ``whole``.  A merged layer has no
        dead rows of its own layers, and keeps ``gone`` only where older layers are
        left.  Writes meanwhile stay, as rows keep their ``seq``; a bucket whose layers
        another merge has taken is left as that left it.
        """
        runs: dict[str, list[dict]] = {}
        older: dict[str, bool] = {}
        folders = self._manifest()["folders"]
        for b, layers in folders.items():
            start, total = len(layers), 0
            while start and (whole or not total or layers[start - 1]["rows"] + layers[start - 1]["gone"] <= TIER * total):
                start -= 1
                total += layers[start]["rows"] + layers[start]["gone"]
            if len(layers) - start > 1 or (start == 0 and layers[0]["gone"]):
                runs[b], older[b] = layers[start:], start > 0
        if not runs:
            return 0
        layers = [(b, x) for b in sorted(runs) for x in runs[b]]
        folder, bucket = uuid.uuid4().hex, self._bucket(self._manifest()["buckets"])
        for name, schema in (("chunks", CHUNKS), ("documents", DOCUMENTS)):
            held = self._write(folder, name, self._live(name, schema, layers).withColumn("bucket", bucket))
        gone = self._scan("gone", GONE, [(b, x) for b, x in layers if older[b]]).groupBy("path").agg(F.max("below").alias("below"))
        dead = self._write(folder, "gone", gone.withColumn("bucket", bucket))

        def change(now: dict, number: int) -> dict:
            folders = dict(now["folders"])
            for b, run in runs.items():
                at = [k for k in range(len(folders.get(b, []))) if folders[b][k : k + len(run)] == run]
                if at:
                    one = {"folder": folder, "rows": held.get(b, 0), "gone": dead.get(b, 0)}
                    folders[b] = [*folders[b][: at[0]], *([one] if one["rows"] or one["gone"] else []), *folders[b][at[0] + len(run) :]]
            return {**now, "folders": {b: x for b, x in folders.items() if x}}

        self._publish_change(change)
        return len(runs)

    # Operations

    def ingest(self, incoming: DataFrame, embedder=None, size: int = 1200, overlap: int = 200, force: bool = False, cache=None) -> DataFrame:
        """Upsert ``incoming(path, sha256, text)``; returns ``path, status, chunks,
        message``.

        An unchanged hash skips a document, whatever the chunking was; a document
        without chunks keeps what the store has, and so does one whose ``error`` says
        why it was not read.  Of rows that share a path the one of the greatest hash
        and text counts.  With a cache (:class:`.embed.VectorCache`) only texts that it
        does not know are embedded.
        """
        from . import embed as E

        base = self.version() or 0
        if "error" not in incoming.columns:
            incoming = incoming.withColumn("error", F.lit(None).cast("string"))
        one = incoming.groupBy("path").agg(F.max(F.struct("sha256", "text", "error")).alias("x")).select("path", "x.*")
        seen = with_status(one, self.documents(version=base))
        failed = F.col("error").isNotNull()
        skipped = (F.col("status") == "unchanged") & ~F.lit(force)
        # Written with the documents that are left as they are, so that texts are shuffled once.
        cut = seen.withColumn("parts", F.when(~skipped, T.chunk(F.col("text"), size, overlap)))
        chunks = F.greatest(F.coalesce(F.size("parts"), F.lit(0)), F.lit(0))
        cut = materialize(cut.select("path", "sha256", "status", "error", "parts", chunks.alias("chunks")), "ingest-cut")
        status = F.when(failed, "error").when(~skipped & (F.col("chunks") == 0), "empty").otherwise(F.col("status"))
        report = cut.select("path", status.alias("status"), "chunks", F.col("error").alias("message"))
        report = materialize(report, "ingest")
        full = cut.where("chunks > 0")
        if not full.isEmpty():
            rows = full.select("path", F.posexplode("parts").alias("ord", "text")).withColumn("hash", E.text_hash())
            distinct, embedder = rows.select("hash", "text").dropDuplicates(["hash"]), embedder or E.HashEmbedder()
            vectors = cache.fill(distinct, embedder) if cache else E.embed(distinct, embedder)
            fresh = rows.join(vectors.select("hash", F.col("vector").alias("vec")), "hash")
            documents = full.select("path", "sha256", "chunks", F.current_timestamp().alias("added_at"))
            self._commit(base, documents, fresh.select("path", "ord", "text", "vec"), full.where("status <> 'new'").select("path"))
        return report

    def forget(self, pattern: str) -> int:
        """Drop documents whose path matches, with their chunks; how many."""
        base = self.version() or 0
        gone = materialize(self.documents(version=base).where(matches(F.col("path"), pattern)).select("path"), "forget")
        count = gone.count()
        if count:
            self._commit(base, None, None, gone)
        return count

    def listing(self) -> DataFrame:
        return listed(self.documents())
