"""Commands, settings layers, services, cache and names of definitions."""

import http.server
import json
import threading

import pytest

from lexigrid import cli
from lexigrid.plans import dupcheck, settings
from lexigrid.sources import chat, code, embed
from lexigrid.sources.code import Node
from lexigrid.sources.files import list_documents, list_sources
from lexigrid.streaming.progress import Progress


class Service(http.server.BaseHTTPRequestHandler):
    """Answers like an embeddings and chat service, rows out of order."""

    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, body, self.headers.get("Authorization")))
        self.send_response(200)
        self.end_headers()
        if self.path.endswith("/embeddings"):
            vectors = embed.HashEmbedder(dim=16).embed(body["input"])
            rows = [{"index": k, "embedding": [3 * x for x in v]} for k, v in enumerate(vectors)]
            self.wfile.write(json.dumps({"data": rows[::-1]}).encode())
        elif body["stream"]:
            for line in (": hello", 'data: {"choices":[{"delta":{"content":"Nine "}}]}', "data: {", 'data: {"choices":[]}',
                         'data: {"choices":[{"delta":{"content":"isles."}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"no"}}]}'):
                self.wfile.write((line + "\r\n\r\n").encode())
        else:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "Nine."}}]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture()
def service(monkeypatch):
    for s in settings.SETTINGS:
        monkeypatch.delenv(s.env, raising=False)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked = []
    yield f"http://127.0.0.1:{server.server_port}/v1/"
    server.shutdown()


def test_ask_and_chat(spark, tmp_path, capsys, service, monkeypatch):
    (tmp_path / "a.md").write_text("The orchard has nine islands.")
    (tmp_path / "odd.bin").write_text("A file that is named itself.")
    here = ["-w", str(tmp_path), "--url", service, "--api-key", "k"]
    cli.main(["ingest", str(tmp_path / "a.md"), str(tmp_path / "odd.bin"), str(tmp_path / "none"), *here])
    out = capsys.readouterr()
    assert out.out.count("+ 1") == 2 and "nothing at" in out.err and "2 chunks written" in out.err
    cli.main(["ask", "nine islands", "--min-score", "-1", "--show-context", *here])
    out = capsys.readouterr().out
    assert "Context:\n[source: " in out and "Nine isles.\n" in out and out.endswith("sources: a.md, odd.bin\n")
    assert Service.asked[-1][2] == "Bearer k" and Service.asked[-1][1]["model"] == "gpt-4o-mini"
    cli.main(["ask", "islands", "-q", "-k", "1", "--no-stream", "--temperature", "0", *here])
    assert capsys.readouterr().out == "Nine.\n" and Service.asked[-1][1]["temperature"] == 0
    lines = iter(["hello", "", "/rag", "nine islands", "/sources", "/system be brief", "/what", f"/save {tmp_path}/t.md", "again", "/reset", "/rag off", "/help", "/exit"])
    args = cli.parser().parse_args(["chat", "--history-turns", "1", "--min-score", "-1", *here])
    cli.do_chat(cli.Session(args), lambda _: next(lines))
    out = capsys.readouterr().out
    assert "rag on" in out and "unknown command" in out and "history cleared" in out and "sources: " in out
    assert (tmp_path / "t.md").read_text() == "**user**: hello\n\n**assistant**: Nine isles.\n\n**user**: nine islands\n\n**assistant**: Nine isles."
    last = [b for p, b, _ in Service.asked if p.endswith("completions")][-1]["messages"]
    assert [m["role"] for m in last] == ["system", "user", "assistant", "user"] and last[0]["content"] == "be brief"
    assert last[1]["content"] == "nine islands" and last[3]["content"].startswith("Context:\n")
    with pytest.raises(ValueError, match="url"):
        cli.main(["chat", "-w", str(tmp_path)])


def test_settings_layers(tmp_path, monkeypatch, capsys):
    for s in settings.SETTINGS:
        monkeypatch.delenv(s.env, raising=False)
    inner = tmp_path / "a/b"
    inner.mkdir(parents=True)
    cli.main(["init", "-w", str(tmp_path), "--url", "http://far", "--api-key", "secret"])
    cli.main(["init", "-w", str(inner), "--model", "near"])
    with pytest.raises(FileExistsError):
        cli.main(["init", "-w", str(inner)])
    (inner / ".lexigrid/config.json").write_text(json.dumps({"model": "near", "verify_ssl": False, "timeout": True, "url": ""}))
    monkeypatch.setenv("LLM_EMBED_BATCH", " 7 ")
    got = settings.effective(str(inner), {"embed_model": "flag"})
    assert {k: v for k, (v, _) in got.items()} == {
        "url": "http://far", "api_key": "secret", "model": "near", "embed_model": "flag", "ca_bundle": "", "verify_ssl": False,
        "timeout": 300, "embed_batch": 7, "dupcheck_max_memory_mb": 2048, "system_prompt": "",
    }
    assert settings.effective(str(inner), inherit=False)["url"] == ("", "default")
    capsys.readouterr()
    cli.main(["config", "-w", str(inner), "--embed-model", "flag"])
    lines = {x.split()[0]: x.split(maxsplit=1)[1] for x in capsys.readouterr().out.splitlines()}
    assert lines["api_key"].startswith("set  (inherited from ") and lines["model"] == "near  (here)" and lines["verify_ssl"] == "false  (here)"
    assert lines["embed_batch"] == "7  ($LLM_EMBED_BATCH)" and lines["embed_model"] == "flag  (this command)" and lines["ca_bundle"] == "(unset)  (default)"
    cli.main(["model", "other", "-w", str(inner)])
    cli.main(["model", "-w", str(inner)])
    assert capsys.readouterr().out.splitlines()[-1] == "other"
    monkeypatch.setenv("LLM_EMBED_BATCH", "x")
    with pytest.raises(ValueError, match="LLM_EMBED_BATCH"):
        settings.effective(str(inner))
    (tmp_path / "job.json").write_text(json.dumps({"include": ["s"], "min_lines": True}))
    with pytest.raises(ValueError, match="min_lines"):
        settings.Job.load(str(tmp_path / "job.json"))


def test_listing(spark, tmp_path):
    for name in ("d/a.py", "d/vendor/b.py", "d/.c.md", "d/g.odd", "d/e/f.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    d, missing = str(tmp_path / "d"), []
    names = lambda df: sorted(r["path"].removeprefix(f"{d}/") for r in df.collect())
    assert names(list_documents(spark, [d, d, f"{d}/g.odd", f"{d}/a.py", f"{d}/no"], on_missing=missing.append)) == ["a.py", "e/f.md", "g.odd", "vendor/b.py"]
    assert missing == [f"{d}/no"]
    assert names(list_documents(spark, d, recursive=False)) == ["a.py"]
    assert names(list_sources(spark, d, ["py"])) == ["a.py"] and names(list_sources(spark, [f"{d}/vendor/b.py", f"{d}/no"], [".PY"])) == ["vendor/b.py"]


def counting(log, fail_after=10**9):
    """An embedder that notes each batch in a file, and stops when told to."""
    class Counting(embed.HashEmbedder):
        def embed(self, texts):
            with open(log, "a") as f:
                f.write("x" * len(texts) + "\n")
            if len(open(log).read().splitlines()) > fail_after:
                raise OSError("stopped")
            return embed.HashEmbedder.embed(self, texts)

    return Counting(batch=5)


def test_cache_keeps_what_an_interrupted_run_did(spark, tmp_path):
    log = str(tmp_path / "log")
    texts = spark.createDataFrame([(f"t{k}",) for k in range(40)], "text string").withColumn("hash", embed.text_hash())
    cache, told = embed.VectorCache(spark, f"file://{tmp_path}/cache", rows_per_commit=10), []
    with pytest.raises(Exception, match="stopped"):
        cache.fill(texts, counting(log, 4), lambda done, of: told.append((done, of)))
    known = cache.rows("hash-64").count()
    assert told and 0 < known < 40
    open(log, "w").close()
    assert cache.fill(texts.unionAll(texts), counting(log)).count() == 40
    assert sum(len(x) for x in open(log).read().splitlines()) == 40 - known
    open(log, "w").close()
    assert cache.fill(texts, counting(log)).count() == 40 and open(log).read() == ""
    assert cache.rows("other").count() == 0
    seen = []
    assert len(embed.embed_list(["a", "b", "c"], embed.HashEmbedder(batch=2), lambda at, v: seen.append((at, len(v))))) == 3
    assert seen == [(0, 2), (2, 1)]


def test_duplicate_check_command(spark, tmp_path, capsys):
    code_ = "def f(a):\n    x = 0\n    for v in a:\n        x += v\n    return x\n"
    for k in range(3):
        (tmp_path / f"m{k}.py").write_text(code_.replace("f(", f"f{k}("))
    job = str(tmp_path / "job.json")
    cli.main(["dupcheck", "init", job, "--include", ".", "--ext", ".py"])
    with pytest.raises(FileExistsError):
        cli.main(["dupcheck", "init", job])
    cli.main(["dupcheck", "run", job, "--threshold", "0.2", "--report", "clusters", "--no-idf", "-w", str(tmp_path)])
    out = capsys.readouterr()
    assert "3 files, 3 units" in out.err and "3 pairs" in out.err and "1 clusters" in out.err and "cluster 1 (3 matches):" in out.out
    assert embed.VectorCache(spark, f"{job}.vectors").rows("hash-64").count() == 3
    cli.main(["dupcheck", "run", job, "--threshold", "0.2", "--top-n", "1", "--output", "markdown", "--output-file", str(tmp_path / "r.txt"), "--no-cache", "-w", str(tmp_path)])
    assert len((tmp_path / "r.md").read_text().splitlines()) == 3
    with pytest.raises(ValueError, match="two units"):
        dupcheck.run(spark, settings.Job(include=[str(tmp_path)], extensions=[".none"]))


def tree(kind, *children, text="", **roles):
    node = Node(kind, 1, 9, text)
    for role, child in roles.items():
        node.add(child, role)
    for child in children:
        node.add(child)
    return node


def leaf(text, kind="identifier"):
    return Node(kind, 1, 1, text)


def test_names_of_definitions():
    assert code.name_of(tree("class_definition", name=leaf("Named"), declarator=leaf("no"))) == "Named"
    deep = leaf("deep")
    for _ in range(4):
        deep = tree("pointer_declarator", declarator=deep)
    assert code.name_of(tree("function_definition", declarator=deep)) == "deep"
    for _ in range(4):
        deep = tree("pointer_declarator", declarator=deep)
    assert code.name_of(tree("function_definition", declarator=deep)) == ""
    assert code.name_of(tree("function_definition", declarator=tree("function_declarator", leaf("(", "("), leaf("beside")))) == "beside"
    assert code.name_of(tree("type_declaration", tree("type_spec", name=leaf("Spec")))) == "Spec"
    made = Node("arrow_function", 1, 9)
    tree("variable_declarator", made, name=leaf("bound"))
    assert code.name_of(made) == "bound"
    made = Node("function_expression", 1, 9)
    tree("object", tree("pair", tree("parenthesized_expression", made), key=leaf("key")))
    assert code.name_of(made) == "key"
    itself = Node("function_expression", 1, 9, "itself")
    tree("pair", name=itself)
    assert code.name_of(itself) == ""
    far = Node("arrow_function", 1, 9)
    tree("a", tree("b", tree("c", far)), name=leaf("far"))
    assert code.name_of(far) == ""
    assert code.name_of(tree("singleton_method", leaf("(", "("), leaf("word", "word"))) == "word"


def test_stream_pieces():
    assert list(chat.pieces(["data: x", "event: y", 'data: {"choices":[{"delta":{"content":"a"}},{"delta":{"content":"b"}}]}', "data: [DONE]"])) == ["a"]


def test_progress(spark, tmp_path):
    said = []
    listener = Progress(said.append)
    spark.streams.addListener(listener)
    rows = spark.range(7)
    rows.write.parquet(f"{tmp_path}/in")
    q = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    for _ in range(100):
        if "ended" in said:
            break
        threading.Event().wait(0.1)
    spark.streams.removeListener(listener)
    assert said[0].endswith("started") and any("7 rows" in x for x in said) and said[-1] == "ended"
