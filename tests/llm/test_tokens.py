"""Token counting, ids, Simple-8b files and packing against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigrid.llm import packing, simple8b, token_counts, token_files
from lexigrid.llm.common import fresh_path
from lexigrid.llm.token_ids import WordEncoder
from lexigrid.llm.wordpiece_fst import Transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = ["", "don't it's we'll 'S I'M 'tis ''s '", "a<|endoftext|>b <|endoftext|>!<|startoftext|>", "<|endoftext|", "a\x1cb \x85x", "ΑΣ ΣΑΣ. İI", "x" * 3000, "日本語😀a", "a'sb's!'s", "ﬁ①②3é "]


def made(n, seed=1):
    rng = random.Random(seed)
    signs = "ab'st reév ΣİＡ１2!?<|>\n\t́ßſ日😀\x1c\x1f\x0b\x00﻿-_."
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(n // 4)]
    latin = "abcXYZéÉÀßÿÞ .,!?#$%&*()-_=+[]{}|;:\"/<>@^~`0123\n\t"
    return SPECIAL + out + ["".join(rng.choice(latin) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", None) for k, t in enumerate(made(60))] + [(None, "null id", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1), (900, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def test_transducer(library):
    texts = made(800)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    machine = Transducer(PATH)
    assert machine.counts(texts).tolist() == expected
    # A full table is rebuilt without change of results.
    small = Transducer(PATH, max_states=50)
    assert np.concatenate([small.counts(texts[k : k + 40]) for k in range(0, len(texts), 40)]).tolist() == expected
    # Heads of chunks are composed whatever the width is.
    data = np.frombuffer(("thequickbrown" * 40).encode(), np.uint8)
    first = np.zeros(len(data), bool)
    first[[0, 200, 411]] = True
    assert {int(machine.run(data, first, w, piece).sum()) for w in (1, 3, 7, 64, 600) for piece in (1, 100, 5000)} == {int(machine.run(data, first, 1000).sum())}


def test_transducer_of_long_words(library):
    """Words of many chunks: random ones, repeated pieces that never forget where they
    began, and mixtures; with few states the tables are rebuilt inside a word."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["".join(rng.choices(letters, k=20_000)), "x" + "a" * 30_001, "q" + "abc" * 9_000 + " " + "bca" * 9_000, "-" * 20_000]
    made += ["".join(rng.choices(["the", "ing", "a", "ation", "漢字", "é"], k=9_000)), "ab" * 5_000 + "<|endoftext|>" + "ba" * 5_000]
    expected = [len(e.ids) for e in library.encode_batch(made, add_special_tokens=False)]
    machine = Transducer(PATH)
    assert machine.counts(made).tolist() == expected
    assert [int(machine.counts([x])[0]) for x in made] == expected
    small = Transducer(PATH, max_states=500)
    run = small.run
    small.run = lambda data, first: run(data, first, 32, 700)
    assert small.counts(made).tolist() == expected


def test_tables_of_code_points_are_made_by_page(library):
    machine = Transducer(PATH)
    assert not machine.pages.any()
    for text in ("plain", "Ünïcode ΣΑΣ", "漢字 かな", "\U0001f600 \U000e0041", "\u0378 unassigned", ""):
        assert machine.counts([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    assert 0 < machine.pages.sum() < 10


def test_encoder(library):
    texts = made(400)
    small = WordEncoder(PATH, max_words=100, max_hashes=200)
    for k in range(0, len(texts), 50):
        ids, sizes = small.encode(texts[k : k + 50])
        for got, e in zip(np.split(ids, np.cumsum(sizes)[:-1]), library.encode_batch(texts[k : k + 50], add_special_tokens=False)):
            assert got.tolist() == e.ids


def test_counts(docs, library):
    rows = {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PATH).collect()}
    expected = {(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()}
    assert rows == expected
    assert token_counts.count_tokens(docs.where("false"), PATH).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for k in range(200):
        n = int(rng.integers(0, 300))
        values = rng.integers(0, 1 << 63, n, np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        if k % 4 == 0:
            values[:] = 0
        if k % 7 == 0 and n:
            values[0] = (1 << 64) - 1
        ends = np.sort(np.append(rng.integers(0, n + 1, 4), n))
        words, counts = simple8b.encode(values, ends)
        assert (simple8b.decode(words) == values).all() and counts.sum() == len(words)
        at = np.concatenate(([0], np.cumsum(counts)))
        for a, b, lo, hi in zip(at[:-1], at[1:], np.concatenate(([0], ends[:-1])), ends):
            assert (simple8b.decode(words[a:b]) == values[lo:hi]).all()


def test_token_files(spark, docs, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    path = fresh_path(spark, "files")
    token_files.write_token_files(docs, path, PATH, 2)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in docs.collect()), key=lambda d: (d is not None, d))
    start = 0
    left = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == start and len(ids) == r["n_tokens"] and ids[-1] == 2
        match = next(x for x in left if x[0] == r["doc_id"] and library.encode(x[1], add_special_tokens=False).ids == ids[:-1])
        left.remove(match)
        start += r["n_tokens"]
    assert not left
    token_files.write_token_files(docs.where("false"), path + "-none", PATH, 2)
    assert token_files.read_token_files(spark, path + "-none").count() == 0


def test_packing(docs, library):
    size = 64
    packed = packing.pack(docs, PATH, 2, size).withColumn("crc", F.crc32("ids")).collect()
    by_doc = {}
    for r in docs.where("doc_id IS NOT NULL AND doc_id <> 3").collect():
        by_doc[r["doc_id"]] = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
    for d, ids in by_doc.items():
        own = sorted((r for r in packed if r["doc_id"] == d), key=lambda r: r["start"])
        assert [i for r in own for i in np.frombuffer(r["ids"], "<u4")] == ids
        assert {r["doc_tokens"] for r in own} == {len(ids)} and all(r["crc"] == zlib.crc32(r["ids"]) for r in own)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    total = sum(r["length"] for r in packed)
    assert len(sequences) <= 1.1 * total / size + 1
    assert packing.pack(docs.where("false"), PATH, 2, size).count() == 0


def test_packing_many_short_pieces(spark):
    """Runs of a length don't grow with how often it fills up a sequence."""
    rng = np.random.default_rng(0)
    size = 512
    lengths = np.concatenate([rng.integers(2, size + 1, 3000), np.ones(15_000, int)])
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    patterns = packing._packs(counts, size)
    runs = packing._runs(patterns)
    of_one = [r for r in runs if r[0] == 1]
    assert len(of_one) <= len(patterns) and sum(r[2] - r[1] for r in of_one) == counts[1]
    steps, dealt = packing._blocks(runs)
    assert len(dealt) <= 2 * len(runs)
    met = {}
    for n, block, *_ in dealt:
        met[n, block] = met.get((n, block), 0) + 1
    # How many runs all pieces are compared with.
    assert sum(k * dict(steps)[n] for (n, _), k in met.items()) <= 4 * len(lengths)
    rows = spark.range(len(lengths)).select(F.col("id").alias("doc_id"))
    rows = rows.join(spark.createDataFrame(list(enumerate(lengths.tolist())), "doc_id long, length long"), "doc_id")
    nth = F.row_number().over(Window.partitionBy("task", "length").orderBy("doc_id")) - 1
    pieces = rows.withColumn("task", (F.col("doc_id") % 3).cast("int")).withColumn("nth", nth.cast("long"))
    placed = packing.place(pieces, size).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(placed["doc_id"]) == list(range(len(lengths)))
    follows = placed.groupby("sequence_id")["length"].cumsum() - placed["length"]
    assert (follows == placed["offset"]).all() and (placed["offset"] + placed["length"]).max() <= size
    assert placed["sequence_id"].nunique() <= 1.01 * lengths.sum() / size + 1


@pytest.mark.parametrize("seed", range(20))
def test_histogram(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 4096])
    counts = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
    placed = {}
    for many, lengths in packing.pack_histogram(counts, size):
        assert many > 0 and sum(lengths) <= size
        for n in lengths:
            placed[n] = placed.get(n, 0) + many
    assert placed == counts
