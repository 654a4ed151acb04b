"""Layers of the store: what a batch writes, merges, versions, and two writers."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexigrid.sources import embed, store as store_module
from lexigrid.sources.store import Store
from lexigrid.sources.versions import Conflict

SCHEMA = "path string, sha256 string, text string"


def content(store, version=None):
    docs = {r["path"]: r["sha256"] for r in store.documents(version=version).collect()}
    chunks = store.chunks(version=version).select("path", "ord", "text").collect()
    assert len(chunks) == len({(r["path"], r["ord"]) for r in chunks}) and {r["path"] for r in chunks} == set(docs)
    return docs, {(r["path"], r["ord"]): r["text"] for r in chunks}


def rows(spark, held):
    return spark.createDataFrame([(p, t, t) for p, t in held.items()], SCHEMA)


def test_versions_equal_a_plain_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "LAYERS", 3)
    rng, plain, versions = random.Random(4), {}, {}
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    for step in range(6):
        if step == 3:
            gone = [p for p in plain if "/1" in p]
            assert store.forget("/1") == len(gone)
            for p in gone:
                del plain[p]
        else:
            batch = {f"/{rng.randrange(14)}": f"text {step} {k}" for k in range(5)}
            store.ingest(rows(spark, batch))
            plain.update(batch)
        versions[store.version()] = dict(plain)
    store.compact(whole=True)
    versions[store.version()] = dict(plain)
    assert all(len(x) == 1 and not x[0]["gone"] for x in store._manifest()["folders"].values())
    for number, held in versions.items():
        assert content(store, number) == (held, {(p, 0): t for p, t in held.items()})
    assert {r["path"] for r in store.chunks_of(["/3", "/nowhere", *list(plain)[:1]]).collect()} == {"/3", *list(plain)[:1]} & set(plain)
    assert store.documents(version=0).count() == 0
    store.clean()
    assert content(store)[0] == plain and store.compact() == 0
    with pytest.raises(ValueError, match="no version 1"):
        store.documents(version=1)
    assert store.forget("/") == len(plain) and content(store) == ({}, {})
    assert store.compact() > 0 and store._manifest()["folders"] == {}


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)

    def size():
        return sum(p.stat().st_size for p in Path(tmp_path, "s/data").rglob("*.parquet"))

    rng = random.Random(1)
    store.ingest(spark.range(2000).select(F.concat(F.lit("/"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.sha2(F.col("id").cast("string"), 512).alias("text")))
    first = size()
    store.ingest(rows(spark, {f"/{rng.randrange(2000)}": "changed"}))
    changed = size() - first
    assert changed < first / 20
    store.forget("/77_")
    assert size() - first - changed < first / 20
    assert store.documents().count() == store.chunks().count() == 2000 - sum("/77" in f"/{k}" and len(str(k)) > 2 for k in range(2000))


def test_layers_that_are_merged_are_of_like_size(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(Store, "_write", lambda self, folder, table, df: made.append(table) or {})
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    sizes = {"0": [1000, 30, 9, 3, 1], "1": [1000, 10, 3, 2, 1]}
    store._publish(1, {"buckets": 2, "dim": None, "changed": {}, "folders": {b: [{"folder": f"{b}-{k}", "rows": 0, "gone": n} for k, n in enumerate(s)] for b, s in sizes.items()}})
    monkeypatch.setattr(Store, "_scan", lambda self, table, schema, layers: spark.createDataFrame([], schema))
    monkeypatch.setattr(Store, "_live", lambda self, table, schema, layers: spark.createDataFrame([], f"{schema}, seq long"))
    assert store.compact() == 1 and made == ["chunks", "documents", "gone"]
    # In bucket 0 the layer of 1 is not joined by that of 3, which is more than twice as much.
    assert {b: [x["gone"] for x in layers] for b, layers in store._manifest()["folders"].items()} == {"0": sizes["0"], "1": [1000]}


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    Store(spark, root, buckets=8).ingest(rows(spark, {f"/{k}": "old" for k in range(9)}))
    bucket = {r["path"]: r["b"] for r in spark.range(9).select(F.concat(F.lit("/"), "id").alias("path")).select("path", F.pmod(F.xxhash64("path"), F.lit(8)).alias("b")).collect()}
    other = next(p for p in bucket if bucket[p] != bucket["/0"])

    class Slow(Store):
        """Something else happens before it publishes the first time."""

        meanwhile = None

        def _publish(self, number, manifest):
            act, self.meanwhile = self.meanwhile, None
            if act:
                act(Store(spark, root))
            super()._publish(number, manifest)

    slow = Slow(spark, root)
    slow.meanwhile = lambda s: s.ingest(rows(spark, {other: "theirs"}))
    slow.ingest(rows(spark, {"/0": "ours"}))
    docs = content(slow)[0]
    assert slow.version() == 3 and docs["/0"] == "ours" and docs[other] == "theirs"
    # A merge changes no content, so a write goes on top of it, and it on top of a write.
    slow.meanwhile = lambda s: s.compact(whole=True)
    slow.ingest(rows(spark, {"/0": "again"}))
    slow.meanwhile = lambda s: s.ingest(rows(spark, {"/0": "last"}))
    slow.compact(whole=True)
    assert content(slow)[0] == {f"/{k}": "old" for k in range(9)} | {"/0": "last", other: "theirs"}
    before = slow.version()
    slow.meanwhile = lambda s: s.ingest(rows(spark, {"/0": "first"}))
    with pytest.raises(Conflict):
        slow.forget("/0")
    assert slow.version() == before + 1 and content(slow)[0]["/0"] == "first"


def test_stores_with_one_folder_a_bucket_are_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    store.ingest(rows(spark, {"/a": "x", "/b": "y"}))
    held = store._manifest()
    store._publish(2, {"buckets": 2, "dim": held["dim"], "folders": {b: x[0]["folder"] for b, x in held["folders"].items()}})
    store.ingest(rows(spark, {"/a": "z"}))
    assert content(store)[0] == {"/a": "z", "/b": "y"}


def test_cache_reads_each_missing_text_once_and_the_last_vector_wins(spark, tmp_path):
    class Counting(embed.HashEmbedder):
        pass

    cache = embed.VectorCache(spark, f"file://{tmp_path}/c", rows_per_commit=3)
    texts = spark.range(10).select(F.col("id").cast("string").alias("text")).withColumn("hash", embed.text_hash())
    said = []
    assert cache.fill(texts, Counting(), lambda k, n: said.append((k, n))).count() == 10
    assert said == [(k, 4) for k in range(1, 5)]
    assert cache.fill(texts, Counting(), lambda k, n: said.append((k, n))).count() == 10 and len(said) == 4
    # Another run commits the same hash later.
    later = texts.limit(1).select("hash", F.lit("hash-64").alias("model"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    cache.add("hash-64", later)
    found = {r["hash"]: r["vector"] for r in cache.rows("hash-64").collect()}
    assert len(found) == 10 and found[later.first()["hash"]] == [1.0]


def test_texts_are_grouped_once(spark, tmp_path, monkeypatch):
    """The report of a batch comes from what was written of it, not from the texts again."""
    from lexigrid.sources import store as module

    plans, write = {}, module.materialize

    def held(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(module, "materialize", held)
    rows = spark.createDataFrame([("a", "1", "one"), ("b", "2", ""), ("a", "0", "less")], "path string, sha256 string, text string")
    report = module.Store(spark, f"file://{tmp_path}/store").ingest(rows)
    assert sorted(map(tuple, report.collect())) == [("a", "new", 1, None), ("b", "empty", 0, None)]
    assert "Exchange" in plans["ingest-cut"] and "Exchange" not in plans["ingest"]


def _distinct(spark, d, of):
    return spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").where(of).select("text").distinct()


def test_the_resumed_cache_commits_by_hundreds(spark, sf, monkeypatch):
    """Commits are as many as the texts need, not as few for any table."""
    from lexigrid.plans import catalogue

    said, plain = [], embed.VectorCache.fill
    monkeypatch.setattr(embed.VectorCache, "fill", lambda self, texts, embedder: plain(self, texts, embedder, lambda k, n: said.append((k, n))))
    for d in (sf, "/root/testdata/sf0.01"):
        said.clear()
        every, some = _distinct(spark, d, "true").count(), _distinct(spark, d, "lang = 'en'").count()
        assert catalogue.cache_resume(spark, d).count() == every
        assert said == [(k + 1, n) for n in (-(-some // 100), -(-(every - some) // 100)) for k in range(n)]


def test_a_round_has_a_task_for_each_commit_which_keeps_what_others_lose(spark, tmp_path):
    class Failing(embed.HashEmbedder):
        def embed(self, texts):
            if self.bad in texts:
                # By then the round's other commits are done.
                time.sleep(5)
                raise OSError("stopped")
            return embed.HashEmbedder.embed(self, texts)

    texts = spark.range(70).select(F.col("id").cast("string").alias("text")).withColumn("hash", embed.text_hash())
    part = F.pmod(F.xxhash64("hash"), F.lit(7)).alias("part")
    sizes = {r["part"]: r["count"] for r in texts.groupBy(part).count().collect()}
    failing, said = Failing(), []
    failing.bad = texts.where(part == 4).first()["text"]
    cache = embed.VectorCache(spark, f"file://{tmp_path}/c", rows_per_commit=10)
    with pytest.raises(Exception, match="stopped"):
        cache.fill(texts, failing, lambda k, n: said.append((k, n)))
    assert said == [(k, 7) for k in (1, 2, 3)]
    assert cache.rows("hash-64").count() == 70 - sizes[4]
    failing.bad, said = None, []
    assert cache.fill(texts, failing, lambda k, n: said.append((k, n))).count() == 70
    assert said == [(k, -(-sizes[4] // 10)) for k in range(1, -(-sizes[4] // 10) + 1)]
    held = [n for _, n in spark.read.option("recursiveFileLookup", "true").parquet(cache._folder("hash-64")).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert max(held) <= max(sizes.values()) and sum(held) == 70
