"""Document and source-code files."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Suffixes of files that are read as text.
TEXT_SUFFIXES = (
    ".txt", ".md", ".markdown", ".rst", ".org", ".csv", ".tsv", ".json", ".jsonl",
    ".yaml", ".yml", ".toml", ".ini", ".cfg", ".log", ".html", ".htm", ".xml",
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".c", ".h",
    ".cpp", ".hpp", ".rb", ".sh", ".sql",
)
RICH_SUFFIXES = (".pdf", ".docx")
# Parts of paths that a walk for source code leaves out.
DEFAULT_EXCLUDES = (
    ".git", "__pycache__", "node_modules", "vendor", "dist", "build",
    ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache",
)


def plain_path(path: Column) -> Column:
    """A path without the scheme that Spark's reader puts before it."""
    return F.regexp_replace(path, "^file:/+", "/")


def _found(spark: SparkSession, path: str) -> bool | None:
    """Whether a path is a folder; none if there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).isDirectory() if fs.exists(p) else None


def list_documents(
    spark: SparkSession, paths: str | list[str], recursive: bool = True, on_missing: Callable[[str], None] | None = None
) -> DataFrame:
    """``path, content`` of folders' files whose name is not hidden and whose suffix is
    known, and of files that are named themselves, whatever their suffix; each once.
    Spark reads no hidden files, named or not.

    A path where nothing is is left out, and ``on_missing`` is told.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    kinds = {p: _found(spark, p) for p in dict.fromkeys(given)}
    for p, kind in kinds.items():
        if kind is None and on_missing:
            on_missing(p)
    out = spark.createDataFrame([], "path string, content binary")
    path = plain_path(F.col("path"))
    folders, files = [p for p, kind in kinds.items() if kind], [p for p, kind in kinds.items() if kind is False]
    if folders:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folders)
        known = F.lower(T.suffix(path)).isin(*TEXT_SUFFIXES, *RICH_SUFFIXES)
        out = out.unionAll(read.where(known & ~T.basename(path).startswith(".")).select(path.alias("path"), "content"))
    if files:
        out = out.unionAll(spark.read.format("binaryFile").load(files).select(path.alias("path"), "content"))
    return out.dropDuplicates(["path"])


def list_sources(spark: SparkSession, paths: str | list[str], extensions: list[str], excludes: tuple[str, ...] = DEFAULT_EXCLUDES) -> DataFrame:
    """``path, content`` of source files; an exclude is any part of a path, and holds
    for what is found in folders, not for files that are named themselves."""
    wanted = [(e if e.startswith(".") else "." + e).lower() for e in extensions]
    out = spark.createDataFrame([], "path string, content binary")
    path = plain_path(F.col("path"))
    for given in dict.fromkeys([paths] if isinstance(paths, str) else paths):
        kind = _found(spark, given)
        if kind is None:
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(given).where(T.suffix(path).isin(*wanted))
        for part in excludes if kind else ():
            files = files.where(~path.contains(part))
        out = out.unionAll(files.select(path.alias("path"), "content"))
    return out.dropDuplicates(["path"])


def read_docx(content: bytes) -> str:
    """Paragraphs of a word-processing document, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        root = ElementTree.fromstring(packed.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(space + "t")) for p in root.iter(space + "p"))


def read_pdf(content: bytes) -> str:
    """Text of a PDF's pages with a blank line between, if pypdf is there."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package") from e
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def document_text(files: DataFrame) -> DataFrame:
    """``path, sha256, text, error``; text files stay in the JVM."""
    path = F.col("path")
    digest = F.sha2("content", 256)
    plain = files.where(~T.suffix(path).isin(*RICH_SUFFIXES)).select(
        "path", digest.alias("sha256"), T.universal_newlines(T.decode(F.col("content"))).alias("text"), F.lit(None).cast("string").alias("error")
    )

    def rich(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    texts.append(read_pdf(raw) if p.lower().endswith(".pdf") else read_docx(raw))
                    errors.append(None)
                except Exception as e:  # one bad file does not end an ingest
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": batch["path"], "sha256": batch["sha256"], "text": texts, "error": errors})

    others = files.where(T.suffix(path).isin(*RICH_SUFFIXES)).select("path", digest.alias("sha256"), "content")
    return plain.unionByName(others.mapInPandas(rich, "path string, sha256 string, text string, error string"))


def canonical(path: str) -> str:
    return os.path.realpath(re.sub(r"^file:/+", "/", path))
