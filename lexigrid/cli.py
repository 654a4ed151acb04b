"""Command line: init, config, model, chat, ask, ingest, docs, forget, dupcheck."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.vectors import top_k
from .plans import dupcheck, rag, report, settings
from .sources import embed
from .sources.chat import ChatEndpoint
from .sources.files import document_text, list_documents
from .sources.store import Store

MARKS = {"unchanged": "=", "empty": "!", "error": "!"}
HELP = "/rag [off]  /sources  /system TEXT  /reset  /save FILE  /help  /exit"


def _endpoint(url: str, path: str) -> str:
    """:func:`lexigrid.functions.text.endpoint` for one address."""
    base = url.rstrip("/")
    for ending in ("/chat/completions", "/embeddings", "/completions"):
        if base.endswith(ending):
            base = base[: -len(ending)]
            break
    return f"{base}/{path}"


class Session:
    """What commands share: effective settings, store, embedder and chat service."""

    def __init__(self, args: argparse.Namespace):
        self.args = args
        flags = {s.name: getattr(args, s.name, None) for s in settings.SETTINGS}
        self.settings = settings.effective(args.workspace, flags, not args.no_inherit)
        self._spark: SparkSession | None = None

    def __getitem__(self, name: str):
        return self.settings[name][0]

    @property
    def spark(self) -> SparkSession:
        self._spark = self._spark or SparkSession.builder.appName("lexigrid").getOrCreate()
        return self._spark

    @property
    def store(self) -> Store:
        return Store(self.spark, self.args.store or str(Path(self.args.workspace).resolve() / settings.FOLDER / "store"))

    def _service(self) -> dict:
        return {"api_key": self["api_key"], "timeout": self["timeout"], "verify": self["verify_ssl"], "ca_bundle": self["ca_bundle"]}

    def embedder(self) -> embed.Embedder:
        """The embedding service, or hashed words where no address is set."""
        if not self["url"]:
            return embed.HashEmbedder()
        return embed.EndpointEmbedder(_endpoint(self["url"], "embeddings"), self["embed_model"], batch=self["embed_batch"], **self._service())

    def chat(self) -> ChatEndpoint:
        settings.require({"url": self["url"]}, "url")
        return ChatEndpoint(_endpoint(self["url"], "chat/completions"), self["model"], **self._service())

    def hits(self, question: str) -> DataFrame:
        """``query_id, rank, score, path, text`` of the chunks nearest to a question."""
        vector = embed.embed_list([question], self.embedder())[0]
        chunks = self.store.chunks().withColumn("vec_id", F.xxhash64("path", "ord"))
        asked = self.spark.createDataFrame([(0, vector)], "vec_id long, embedding array<float>")
        found = top_k(chunks.select("vec_id", F.col("vec").alias("embedding")), asked, self.args.top_k, self.args.min_score)
        return found.join(chunks.select("vec_id", "path", "text"), "vec_id")

    def asked(self, question: str, system: str, chat: bool) -> tuple[list[dict], str, list]:
        """Messages for a question with its context, the sources, and the hits."""
        hits = self.hits(question).orderBy("rank").collect()  # at most top_k
        found = rag.context(self.spark.createDataFrame(hits, "vec_id long, query_id long, score double, rank int, path string, text string"))
        one = self.spark.createDataFrame([(0, question)], "query_id long, question string").join(found, "query_id", "left")
        row = rag.messages(one, system, chat).first()
        sources = ", ".join(sorted({r["path"].rsplit("/", 1)[-1] for r in hits}))
        return [{"role": "system", "content": row["system"]}, {"role": "user", "content": row["user"]}], sources, hits

    def reply(self, messages: list[dict]) -> str:
        """The service's answer, printed as it comes unless told otherwise."""
        if self.args.no_stream:
            text = self.chat().answer(messages, self.args.temperature)
            print(text)
            return text
        parts = []
        for piece in self.chat().stream(messages, self.args.temperature):
            parts.append(piece)
            print(piece, end="", flush=True)
        print()
        return "".join(parts)


@dataclass
class Talk:
    """A conversation: commands with a slash, everything else is asked."""

    session: Session
    rag: bool
    system: str
    turns: int
    history: list[dict] = field(default_factory=list)
    last: list = field(default_factory=list)

    def say(self, line: str) -> bool:
        """Act on a line; whether the conversation goes on."""
        line = line.strip()
        if line.startswith("/"):
            name, _, rest = line.partition(" ")
            if name.lower() in ("/exit", "/quit", "/q"):
                return False
            print(self._command(name.lower(), rest.strip()))
        elif line:
            self._ask(line)
        return True

    def _command(self, name: str, rest: str) -> str:
        if name == "/rag":
            self.rag = rest != "off"
            return f"rag {'on' if self.rag else 'off'}"
        if name == "/system":
            self.system = rest or self.system
            return "system prompt updated"
        if name == "/reset":
            self.history.clear()
            return "history cleared"
        if name == "/sources":
            return "\n".join(f"[{r['score']:.3f}] {r['path']}\n{r['text'][:400]}" for r in self.last) or "(nothing retrieved yet)"
        if name == "/save":
            path = Path(rest or "transcript.md").expanduser()
            path.write_text("\n\n".join(f"**{m['role']}**: {m['content']}" for m in self.history))
            return f"wrote {path}"
        return HELP if name == "/help" else "unknown command, see /help"

    def _ask(self, line: str) -> None:
        sources, turn = "", line
        if self.rag:
            messages, sources, self.last = self.session.asked(line, self.system, True)
            turn = messages[1]["content"]
        kept = self.history[-2 * self.turns :] if self.turns else list(self.history)
        answer = self.session.reply([{"role": "system", "content": self.system}, *kept, {"role": "user", "content": turn}])
        self.history += [{"role": "user", "content": line}, {"role": "assistant", "content": answer}]
        if sources:
            print("sources:", sources)


def do_init(s: Session) -> None:
    path = Path(s.args.workspace) / settings.FOLDER / settings.FILE
    if path.exists() and not s.args.force:
        raise FileExistsError(path)
    settings.merge_write(str(path), {x.name: getattr(s.args, x.name, None) for x in settings.SETTINGS})
    print(f"written to {path}")


def do_config(s: Session) -> None:
    print("\n".join(settings.described(s.settings, s.args.workspace)))


def do_model(s: Session) -> None:
    name = "embed_model" if s.args.embed else "model"
    if not s.args.name:
        print(s[name])
        return
    above = settings.folders_above(s.args.workspace)
    own = Path(s.args.workspace) / settings.FOLDER / settings.FILE
    path = own if s.args.here or not above else above[0]
    settings.merge_write(str(path), {name: s.args.name})
    print(f"{name} -> {s.args.name}\nwritten to {path}")


def do_ingest(s: Session) -> None:
    missing = lambda p: print(f"nothing at {p}", file=sys.stderr)
    docs = document_text(list_documents(s.spark, s.args.paths, not s.args.no_recursive, missing))
    new, store = 0, s.store
    cache = embed.VectorCache(s.spark, f"{store.root}/vectors")
    for r in store.ingest(docs, s.embedder(), s.args.chunk_size, s.args.overlap, s.args.force, cache).orderBy("path").toLocalIterator():
        new += r["chunks"] if r["status"] in ("new", "changed") or s.args.force else 0
        print(MARKS.get(r["status"], "+"), r["chunks"], r["path"], *([r["message"]] if r["message"] else []))
    print(f"{new} chunks written", file=sys.stderr)


def do_docs(s: Session) -> None:
    for r in s.store.listing().toLocalIterator():
        print(r["line"])


def do_forget(s: Session) -> None:
    print(s.store.forget(s.args.pattern))


def do_ask(s: Session) -> None:
    messages, sources, _ = s.asked(s.args.question, s["system_prompt"] or rag.SYSTEM, False)
    if s.args.show_context or not s["url"]:
        print(messages[1]["content"])
    if s["url"]:
        s.reply(messages)
    if sources and not s.args.quiet:
        print("sources:", sources)


def do_chat(s: Session, read: Callable[[str], str] = input) -> None:
    s.chat()
    talk = Talk(s, s.args.rag, s.args.system or s["system_prompt"] or (rag.SYSTEM if s.args.rag else rag.PLAIN_SYSTEM), s.args.history_turns)
    print(f"model {s['model']}  rag {'on' if talk.rag else 'off'}  (/help for commands)")
    while True:
        try:
            if not talk.say(read("\n> ")):
                return
        except (EOFError, KeyboardInterrupt):
            print()
            return


def do_dupcheck(s: Session) -> None:
    args = s.args
    if args.action == "init":
        suffixes = [x.strip() for x in (args.ext or ".py").split(",")]
        settings.Job.scaffold(args.job, args.include or ["."], suffixes, args.force)
        return
    if args.action == "update":
        settings.Job.update(args.job)
        return
    job, notes = settings.Job.load(args.job)
    for note in notes:
        print(note, file=sys.stderr)
    given = ("threshold", "min_structure", "min_distinct", "report", "output", "output_file", "top_n")
    off = {"no_filter_callers": args.no_filter_callers, "no_idf_weighting": args.no_idf, "no_cache": args.no_cache}
    job = job.overridden(**{k: getattr(args, k) for k in given}, **off)
    base = Path(args.job).resolve().parent
    job = job.overridden(include=[x if "://" in x else str(base / x) for x in job.include])
    cache = embed.VectorCache(s.spark, job.cache_file or f"{Path(args.job).resolve()}.vectors") if job.cache else None
    say = lambda text: print(text, file=sys.stderr)
    lines = dupcheck.stream(s.spark, job, s.embedder(), cache, say, s["dupcheck_max_memory_mb"] << 20)
    if job.output_file:
        path = Path(report.report_path(job.output_file, job.output))
        with path.open("w") as f:
            f.writelines(line + "\n" for line in lines)
        print(f"wrote {path}", file=sys.stderr)
    else:
        for line in lines:
            print(line)


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    for name in ("url", "api-key", "model", "embed-model", "ca-bundle", "system-prompt"):
        if name != "model":
            common.add_argument(f"--{name}")
    common.add_argument("--model", dest="model")
    common.add_argument("--insecure", dest="verify_ssl", action="store_const", const=False)
    common.add_argument("--timeout", type=int)
    common.add_argument("-w", "--workspace", default=".")
    common.add_argument("--no-inherit", action="store_true")
    answer = argparse.ArgumentParser(add_help=False)
    answer.add_argument("--temperature", type=float)
    answer.add_argument("--no-stream", action="store_true")
    search = argparse.ArgumentParser(add_help=False)
    search.add_argument("-k", "--top-k", type=int, default=4)
    search.add_argument("--min-score", type=float, default=0.0)

    top = argparse.ArgumentParser(prog="lexigrid")
    top.add_argument("--store", help="the store's folder (default: in the workspace)")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, act: Callable[[Session], None], *more: argparse.ArgumentParser) -> argparse.ArgumentParser:
        p = commands.add_parser(name, parents=[common, *more])
        p.set_defaults(act=act)
        return p

    command("init", do_init).add_argument("--force", action="store_true")
    command("config", do_config)
    p = command("model", do_model)
    p.add_argument("name", nargs="?")
    p.add_argument("--embed", action="store_true")
    p.add_argument("--here", action="store_true")
    p = command("ingest", do_ingest)
    p.add_argument("paths", nargs="+")
    p.add_argument("--chunk-size", type=int, default=1200)
    p.add_argument("--overlap", type=int, default=200)
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-recursive", action="store_true")
    command("docs", do_docs)
    command("forget", do_forget).add_argument("pattern")
    p = command("ask", do_ask, answer, search)
    p.add_argument("question")
    p.add_argument("--show-context", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p = command("chat", do_chat, answer, search)
    p.add_argument("--rag", action="store_true")
    p.add_argument("--system")
    p.add_argument("--history-turns", type=int, default=8)
    p = command("dupcheck", do_dupcheck)
    p.add_argument("action", choices=("init", "update", "run"))
    p.add_argument("job")
    p.add_argument("--include", nargs="+")
    p.add_argument("--ext")
    p.add_argument("--force", action="store_true")
    for name, kind in (("threshold", float), ("min-structure", float), ("min-distinct", float), ("output-file", str), ("top-n", int)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--report", choices=("pairwise", "clusters"))
    p.add_argument("--output", choices=("text", "json", "markdown"))
    for name in ("filter-callers", "idf", "cache"):
        p.add_argument(f"--no-{name}", action="store_true")
    p.add_argument("--batch", dest="embed_batch", type=int)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.act(Session(args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
