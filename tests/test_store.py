"""Files, store, cache, search, retrieval, settings, stream."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators.vectors import block_rows, similar_pairs, top_k
from lexigrid.plans import dupcheck, rag, settings
from lexigrid.sources import code, embed
from lexigrid.sources.files import document_text, list_documents, list_sources, read_docx
from lexigrid.sources.store import Store, chunk_rows
from lexigrid.streaming.ingest import ingest_stream


def docx(*lines):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"one\r\ntwo\xff")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "sub/b.md").write_text("# b")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "d.docx").write_bytes(docx("x", "y"))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in document_text(list_documents(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.TXT", "b.md", "d.docx", "bad.docx"}
    assert rows["a.TXT"]["text"] == "one\ntwo�" and rows["d.docx"]["text"] == "x\ny"
    assert rows["bad.docx"]["text"] is None and rows["bad.docx"]["error"]
    assert read_docx(docx("q")) == "q"
    flat = list_documents(spark, str(tmp_path), recursive=False)
    assert "b.md" not in [r["path"].rsplit("/", 1)[1] for r in flat.collect()]


def test_store_ingest_is_incremental(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs = [("/a", "1", "first text"), ("/b", "2", "other"), ("/c", "3", "   ")]

    def ingest(rows, **kw):
        return {r["path"]: (r["status"], r["chunks"]) for r in store.ingest(spark.createDataFrame(rows, "path string, sha256 string, text string"), **kw).collect()}

    assert ingest(docs) == {"/a": ("new", 1), "/b": ("new", 1), "/c": ("empty", 0)}
    assert ingest(docs)["/a"][0] == "unchanged"
    # A document that became empty keeps what the store has; one that is gone stays.
    assert ingest([("/a", "9", ""), ("/b", "8", "x y")]) == {"/a": ("empty", 0), "/b": ("changed", 1)}
    assert {r["path"]: r["sha256"] for r in store.documents().collect()} == {"/a": "1", "/b": "8"}
    assert {r["path"]: r["text"] for r in store.chunks().collect()} == {"/a": "first text", "/b": "x y"}
    vectors = [r["vec"] for r in store.chunks().collect()]
    assert all(np.linalg.norm(v) == pytest.approx(1, abs=1e-6) for v in vectors)
    assert [r["path"] for r in store.listing().collect()] == ["/a", "/b"]
    assert store.forget("/A") == 1 and store.forget("zzz") == 0
    assert [r["path"] for r in store.chunks().collect()] == ["/b"]


def test_store_changes_nothing_if_a_write_fails(spark, tmp_path):
    class Broken(Store):
        def _publish(self, number, manifest):
            raise OSError("no more")

    root = f"file://{tmp_path}/store"
    store, schema = Store(spark, root, buckets=4), "path string, sha256 string, text string"
    store.ingest(spark.createDataFrame([(f"/{k}", str(k), f"text {k}") for k in range(9)], schema))
    before = sorted(r["path"] for r in store.documents().collect())
    folders = store._manifest()["folders"]
    for act in (lambda s: s.ingest(spark.createDataFrame([("/0", "x", "new"), ("/99", "x", "y")], schema)), lambda s: s.forget("/")):
        with pytest.raises(OSError):
            act(Broken(spark, root))
        assert sorted(r["path"] for r in store.documents().collect()) == before and store.version() == 1
    # Two writers of one version: the second fails.
    with pytest.raises(RuntimeError):
        store._publish(1, store._manifest())
    # Only buckets that change are written.
    store.ingest(spark.createDataFrame([("/0", "x", "new")], schema))
    after = store._manifest()["folders"]
    assert store.version() == 2 and sum(after[k] != folders[k] for k in folders) == 1
    old = Store(spark, root)
    assert {r["path"]: r["text"] for r in old.chunks().collect()} == {f"/{k}": f"text {k}" if k else "new" for k in range(9)}
    assert store.clean() == 2 and store.versions() == [2] and store.documents().count() == 9
    with pytest.raises(ValueError, match="numbers"):
        store.ingest(spark.createDataFrame([("/z", "z", "z")], schema), embed.HashEmbedder(dim=8))
    assert store.version() == 2
    assert store.forget("%") == 9 and store.documents().count() == 0


def test_ingest_takes_one_row_a_path_and_reports_errors(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [("/a", "1", "one", None), ("/a", "2", "two", None), ("/b", "3", None, "BadZipFile: no"), ("/c", "4", "x", None)]
    got = store.ingest(spark.createDataFrame(rows, "path string, sha256 string, text string, error string")).collect()
    assert {r["path"]: (r["status"], r["message"]) for r in got} == {"/a": ("new", None), "/b": ("error", "BadZipFile: no"), "/c": ("new", None)}
    assert {r["path"]: r["text"] for r in store.chunks().collect()} == {"/a": "two", "/c": "x"}


def test_stream_runs_twice(spark, tmp_path):
    folder = tmp_path / "in"
    rows = spark.createDataFrame([("/a", "1", "x"), ("/b", "2", "y")], "path string, sha256 string, text string")
    rows.write.parquet(str(folder))
    store = Store(spark, f"file://{tmp_path}/store")
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(folder))
        ingest_stream(stream, store, str(tmp_path / f"progress{k}")).awaitTermination()
    assert store.documents().count() == 2 and store.chunks().count() == 2


def test_scratch_tables(spark):
    import types

    from lexigrid.sources import scratch

    scratch.materialize(spark.range(3), "t")
    assert scratch.clean(spark) >= 1 and scratch.clean(spark) == 0
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(cluster)


def test_cache(spark):
    texts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "")], "pos int, text string").withColumn("hash", embed.text_hash())
    none = spark.createDataFrame([], "hash string, model string, vector array<float>")
    rows, fresh = embed.embed_all(texts, none, embed.HashEmbedder())
    assert rows.count() == 4 and fresh.count() == 3
    again, new = embed.embed_all(texts, fresh.persist(), embed.HashEmbedder())
    assert new.count() == 0 and again.count() == 4
    with pytest.raises(ValueError):
        embed.embed(texts, embed.HashEmbedder(batch=0))


def test_search_and_join_against_loops(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((80, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[7] = v[3]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(None, v[0].tolist()), (99, None)], "vec_id long, embedding array<double>")
    got = top_k(rows, rows.where("vec_id < 5"), 3, 0.1).collect()
    dealt = top_k(rows, rows.where("vec_id < 5"), 3, 0.1, most_broadcast=2).collect()
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in dealt} == {(r["query_id"], r["vec_id"], r["rank"]) for r in got}
    for q in range(5):
        s = v @ v[q]
        best = sorted((x for x in range(80) if s[x] >= 0.1), key=lambda x: (-round(s[x], 12), x))[:3]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best
    exact = {(i, j) for i in range(80) for j in range(i + 1, 80) if v[i] @ v[j] >= 0.6 and 7 not in (i, j)}
    for block in (2000, 9):
        assert {(r["i"], r["j"]) for r in similar_pairs(rows, 0.6, block).collect()} == exact
    assert block_rows(1000, 0) == 1000 and block_rows(1000, 4000) == 1 and block_rows(10, 1 << 30) == 10


def test_context_budget(spark):
    hits = [(1, k, 0.5, f"/d/f{k}.txt", "x" * n) for k, n in enumerate([50, 60, 500, 1], 1)] + [(2, 1, 0.5, "/g.txt", "y" * 300)]
    df = spark.createDataFrame(hits, "query_id int, rank int, score double, path string, text string")
    got = {r["query_id"]: r for r in rag.context(df, 200).collect()}
    blocks = [f"[source: f{k}.txt | relevance 0.50]\n" + "x" * n for k, n in ((1, 50), (2, 60))]
    assert got[1]["context"] == "\n\n---\n\n".join(blocks) and got[1]["sources"] == "f1.txt, f2.txt, f3.txt, f4.txt"
    assert got[2]["context"] == "" and got[2]["blocks"] == 0


def test_messages_and_history(spark):
    asked = spark.createDataFrame([(1, "q", "c"), (2, "q", ""), (3, "q", None)], "query_id int, question string, context string")
    user = {r["query_id"]: r["user"] for r in rag.messages(asked).collect()}
    assert user[1] == "Context:\nc\n\nQuestion: q" and user[2] == user[3] == "(no matching context found in the local store)\n\nQuestion: q"
    assert {r["user"] for r in rag.messages(asked, chat=True).where("query_id > 1").collect()} == {"q"}
    turns = spark.createDataFrame([(1, t, "user", str(t)) for t in range(9)], "conv_id int, turn int, role string, text string")
    assert sorted(r["turn"] for r in rag.history(turns, 2).collect()) == [5, 6, 7, 8]
    assert rag.history(turns, 0).count() == 9 and rag.history(turns, 0, strict_zero=True).count() == 0


def test_settings(spark, tmp_path):
    folders = spark.createDataFrame([("/a",), ("/a/b",), ("/a/bc",), ("/",)], "folder string")
    assert [r["folder"] for r in settings.config_chain(folders, "/a/b").collect()] == ["/a/b", "/a", "/"]
    assert [r["folder"] for r in settings.config_chain(folders, "/a/b", inherit=False).collect()] == ["/a/b"]
    path = str(tmp_path / "x/config.json")
    settings.merge_write(path, {"url": "u", "model": ""})
    assert settings.merge_write(path, {"model": "m"}) == {"url": "u", "model": "m"}
    (tmp_path / "job.json").write_text(json.dumps({"include": ["s"], "extensions": [".py"], "url": "x", "odd": 1}))
    job, notes = settings.Job.load(str(tmp_path / "job.json"))
    assert len(notes) == 2 and job.threshold == 0.9
    assert job.overridden(threshold=0.5, no_cache=True).cache is False
    assert settings.Job.update(str(tmp_path / "job.json")).include == ["s"]
    assert "url" not in json.loads((tmp_path / "job.json").read_text())
    with pytest.raises(ValueError):
        settings.Job().check()
    settings.Job.scaffold(str(tmp_path / "new.json"))
    assert settings.Job.load(str(tmp_path / "new.json")) == (settings.Job(), [])
    with pytest.raises(FileExistsError):
        settings.Job.scaffold(str(tmp_path / "new.json"))
    settings.require({"url": "u"}, "url")
    with pytest.raises(ValueError, match="model"):
        settings.require({"url": "u", "model": ""}, "url", "model")


def test_command_line(spark, tmp_path, capsys):
    from lexigrid import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("The orchard has nine islands.")
    store = ["--store", f"file://{tmp_path}/store"]
    cli.main([*store, "ingest", str(tmp_path / "in")])
    cli.main([*store, "docs"])
    cli.main([*store, "ask", "nine islands", "--min-score", "-1"])
    said = capsys.readouterr().out
    assert "+ 1" in said and "1 chunks" in said and "Context:\n[source: a.md | relevance" in said
    cli.main([*store, "forget", "A.MD"])
    assert capsys.readouterr().out.strip() == "1"


CODE = '''
def total(values):
    out = 0
    for v in values:
        out += v
    return out


def summed(items):
    res = 0
    for i in items:
        res += i
    return res


def caller(xs):
    a = total(xs)
    b = summed(xs)
    return a + b
'''


def test_duplicate_check(spark, tmp_path):
    (tmp_path / "m.py").write_text(CODE)
    (tmp_path / "n.py").write_text(CODE.split("\n\n\n")[0])
    (tmp_path / "broken.py").write_text("def (:\n  x\n  y\n  z\n")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor/v.py").write_text(CODE)
    files = list_sources(spark, str(tmp_path), ["py"])
    assert files.count() == 3
    units = {(r["path"].rsplit("/", 1)[1], r["name"], r["kind"]) for r in code.extract(files).collect()}
    assert units == {("m.py", "total", "function"), ("m.py", "summed", "function"), ("m.py", "caller", "function"), ("n.py", "total", "function"), ("broken.py", "", "window")}
    job = settings.Job(include=[str(tmp_path)], extensions=[".py"], threshold=0.2, output="markdown")
    lines = dupcheck.run(spark, job)
    assert lines[0].startswith("| similarity") and any("total" in x and "summed" in x for x in lines)
    assert not any("caller" in x and ("total" in x or "summed" in x) for x in lines)
    grouped = dupcheck.run(spark, job.overridden(report="clusters"))
    assert grouped[0].startswith("### Cluster 1")
    assert json.loads(dupcheck.run(spark, job.overridden(output="json"))[0])["pairs"]


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("/a", "one\n\ntwo"), ("/b", None), ("/c", "")], "path string, text string")
    assert [(r["path"], r["ord"], r["text"]) for r in chunk_rows(docs).collect()] == [("/a", 0, "one\n\ntwo")]
