"""What leaves a task at once, whatever the size of Spark's batches is."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import inverted
from lexigrid.sources import code, embed


@pytest.fixture()
def tasks(spark, monkeypatch):
    """Functions that are given to ``mapInArrow``, in the order of the calls."""
    found, kind = [], type(spark.range(1))
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *args, **kwargs: (found.append(f), run(self, f, *args, **kwargs))[1])
    return found


def test_cells_of_queries(spark, tasks):
    rng = np.random.default_rng(1)
    index, model = inverted.InvertedFile(spark, "file:///nowhere"), inverted.Model(rng.normal(size=(30, 4)), np.zeros((1, 256, 4)), 30)
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], 0.0)], "query_id long, embedding array<double>, floor double")
    assert index._met(asked, model, lambda q, c, product, floor: np.ones(len(c), bool)).count() == 30
    batch = pa.record_batch({"query_id": np.arange(1000), "embedding": pa.array(rng.normal(size=(1000, 4)).tolist()), "floor": np.zeros(1000)})
    out = list(tasks[-1]([batch]))
    assert max(map(len, out)) <= 30 * inverted.MET and sum(map(len, out)) == 30_000
    assert pa.Table.from_batches(out).column("embedding").combine_chunks().take(pa.array([30 * 500])).to_pylist() == [batch.column("embedding")[500].as_py()]


def test_texts(spark, tasks):
    embed.embed(spark.createDataFrame([("h", "a b")], "hash string, text string"), embed.HashEmbedder(batch=10))
    batch = pa.record_batch({"hash": [str(k) for k in range(95)], "text": [f"word{k} b" for k in range(95)]})
    out = list(tasks[-1]([batch]))
    assert [len(b) for b in out] == [10] * 9 + [5]
    want = np.array(embed.embed_list([f"word{k} b" for k in range(95)], embed.HashEmbedder()))
    assert np.array(pa.Table.from_batches(out).column("vector").to_pylist()) == pytest.approx(want)


def test_units(spark, tasks):
    code.extract(spark.createDataFrame([("a.py", b"x = 1\n")], "path string, content binary"), 2)
    source = b"def f(x):\n    return x\n\ndef g(y):\n    return y\n"
    batch = pa.record_batch({"path": [f"{k}.py" for k in range(2000)], "content": [source] * 2000})
    out = list(tasks[0]([batch]))
    assert max(map(len, out)) <= code.UNITS_AT_ONCE + 2 and sum(map(len, out)) == 4000


def test_words_of_a_batch_are_hashed_once(monkeypatch):
    hashed, plain = [], embed.hashlib.blake2b
    monkeypatch.setattr(embed.hashlib, "blake2b", lambda raw, **kwargs: (hashed.append(raw), plain(raw, **kwargs))[1])
    got = np.array(embed.HashEmbedder(dim=8).embed(["b a A b", "a c", ""]))
    assert sorted(hashed) == [b"a", b"b", b"c"]
    want = np.zeros((3, 8))
    for k, words in enumerate(("baab", "ac", "")):
        for word in words:
            h = int.from_bytes(plain(word.encode(), digest_size=8).digest(), "little")
            want[k, h % 8] += 1 if h >> 63 else -1
    assert got == pytest.approx(want / np.maximum(1e-9, np.linalg.norm(want, axis=1))[:, None], abs=1e-6)


def test_a_commit_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embed, "SPLIT_BYTES", 1 << 20, raising=False)
    words = F.expr("concat_ws(' ', transform(sequence(1, 300), k -> sha2(concat(id, '.', k), 256)))")
    texts = spark.range(1200).select(words.alias("text")).withColumn("hash", embed.text_hash())
    read, plain = [], embed.embed
    monkeypatch.setattr(embed, "embed", lambda texts, embedder: (read.append(texts), plain(texts, embedder))[1])
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        assert embed.VectorCache(spark, f"file://{tmp_path}/c", 700).fill(texts, embed.HashEmbedder()).count() == 1200
        held = [[r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()] for rows in read]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(map(sum, held)) == 1200 and all(len(rows) > 1 for rows in held)
