"""Text functions against plain Python."""

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T


def packed(text, size, overlap):
    """The packing rule, written as a loop."""
    text = re.sub(r"\n{3,}", "\n\n", text.strip())
    out, held = [], ""
    for para in (p.strip() for p in text.split("\n\n")):
        if not para:
            continue
        if len(para) > size and held:
            out, held = out + [held], ""
        while len(para) > size:
            out.append(para[:size])
            para = para[size - overlap :]
        if held and len(held) + 2 + len(para) > size:
            out.append(held)
            held = (held[-overlap:] + "\n\n" + para).strip() if overlap else para
        else:
            held = held + "\n\n" + para if held else para
    return out + [held] if held else out


@pytest.mark.parametrize("size,overlap", [(30, 8), (30, 0), (12, 11), (50, 49)])
def test_chunk(spark, size, overlap):
    rng = random.Random(size * 100 + overlap)
    made = ["", "  \n ", "\n\n\n", "a" * 2500]
    made += ["".join(rng.choice("abc é日😀 \t\n\n\n") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(made)) + [(-1, None)], "id int, text string")
    got = {r["id"]: r["c"] for r in rows.select("id", T.chunk(F.col("text"), size, overlap).alias("c")).collect()}
    assert got.pop(-1) is None
    for k, text in enumerate(made):
        assert got[k] == packed(text, size, overlap), repr(text)


def test_chunk_of_one_long_paragraph(spark):
    row = spark.createDataFrame([("x" * 2500,)], "text string").select(T.chunk(F.col("text")).alias("c")).first()
    assert [len(c) for c in row["c"]] == [1200, 1200, 500]


@pytest.mark.parametrize("overlap", [10, 11, -1])
def test_chunk_checks_its_overlap(overlap):
    with pytest.raises(ValueError):
        T.chunk(F.lit("x"), 10, overlap)


def test_strip_is_that_of_python(spark):
    made = ["\x1c a \x1f", " b ", "\x85c\x0b", "", "\t\n", "d"]
    rows = spark.createDataFrame([(x,) for x in made], "x string")
    assert [r[0] for r in rows.select(T.strip(F.col("x"))).collect()] == [x.strip() for x in made]


def test_dedent(spark):
    rng = random.Random(5)
    made = ["", "a", "  a\n    b\n\n  c", "\ta\n\t b", "\ta\n  b", "   \n  x"]
    made += ["".join(rng.choice("  \tab\n") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in made], "x string")
    for x, r in zip(made, rows.select(T.unit_text(F.col("x"))).collect()):
        assert r[0] == textwrap.dedent(x).strip("\n"), repr(x)


def test_windows(spark):
    for n in range(1, 30):
        text = "\n".join(f"l{k}" if k % 7 else " " for k in range(n))
        got = spark.range(1).select(T.windows(T.lines(F.lit(text)), 8, 2, 2).alias("w")).first()["w"]
        expected, i, rows = [], 0, text.split("\n")
        while i < n:
            end = min(i + 8, n)
            if end - i >= 2 and any(x.strip() for x in rows[i:end]):
                expected.append((i + 1, end, "\n".join(rows[i:end])))
            if end == n:
                break
            i += 6
        assert [tuple(w) for w in got] == expected


def test_decode_and_lines(spark):
    rows = spark.createDataFrame([(bytearray(b"a\xff\r\nb\r"),)], "c binary")
    text = rows.select(T.decode(F.col("c")).alias("t"))
    assert text.first()[0] == "a�\r\nb\r"
    assert text.select(T.lines(F.col("t"))).first()[0] == ["a�", "b"]
    assert text.select(T.universal_newlines(F.col("t"))).first()[0] == "a�\nb\n"


def test_paths(spark):
    rows = spark.createDataFrame([("/a/b.TXT", "b.TXT", ".txt"), ("/a/.hid", ".hid", ""), ("x", "x", ""), ("/q/a.tar.gz", "a.tar.gz", ".gz")], "p string, n string, s string")
    for r in rows.select("n", "s", T.basename(F.col("p")).alias("gn"), T.suffix(F.col("p")).alias("gs")).collect():
        assert (r["gn"], r["gs"]) == (r["n"], r["s"])
