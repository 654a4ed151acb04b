"""Importance resampling and the filter audit against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from lexigrid.llm import filter_audit, resampling

WORDS = "ab cd ef gh ij kl mn op qr st Uv WX".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


# -- resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent=5):
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))

    rows, pool = [], []
    for i, text in docs:
        n, f = features(text)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None])
        if n >= 20:
            pool.append((-score, i is None, i or 0, len(rows) - 1))
    for rank, (*_, at) in enumerate(sorted(pool)[: percent * len(pool) // 100], 1):
        rows[at][4] = rank
    return sorted(map(tuple, rows), key=repr)


EXTRA = "doc_id long, text string, source string, n int, weight string, rank long, part string, key string, bucket int, row int"


def table(spark, rows):
    """Documents with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, "w", 2, "p", "k", 3, 4) for i, t, s in rows], EXTRA)


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (905, "x" * 100_000), (906, "é.漢A_b-9 \x7f\x80"), (None, "no id " * 15), (907, "…" * 30)]


@pytest.mark.parametrize("percent", [5, 40])
def test_resampling(spark, percent):
    rng = random.Random(percent)
    docs = [(k, prose(rng, rng.randint(0, 80), WORDS if k % 3 else [f"v{j}" for j in range(200)])) for k in range(200)]
    docs += [docs[5]] * 3 + EDGES  # repeated rows are drawn each
    target = [prose(rng, 50) for _ in range(20)] + [None, ""]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(table(spark, [(i, t, "s") for i, t in docs]), asked, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    mine, expected = [tuple(r) for r in got.collect()], resampled(docs, target, percent)
    assert sorted(mine, key=repr) == expected
    assert sorted(r[4] for r in mine if r[4]) == list(range(1, len([r for r in mine if r[4]]) + 1))


def test_resampling_of_empty_tables(spark):
    docs = [(k, prose(random.Random(k), 30)) for k in range(40)]
    none = spark.createDataFrame([], "item_id long, text string")
    got = resampling.resample(table(spark, [(i, t, "s") for i, t in docs]), none)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(docs, [])
    assert resampling.resample(table(spark, docs and [(1, "a", "s")]).where("false"), none).count() == 0


def test_streams_of_long_words_and_texts():
    rng = random.Random(3)
    values = ["x" * n + " y " + "z" * m for n in (1, 63, 64, 65, 200) for m in (1, 63, 64, 65, 200)]
    values += [prose(rng, 100_000, [f"w{k}é" for k in range(3000)] + ["q" * 90]), "", "end"]
    stream, words = resampling.bucket_stream(values)
    at = 0
    for value, n in zip(values, words):
        expected = features(value)
        assert expected[0] == n
        assert np.array_equal(np.sort(stream[at : at + len(expected[1])]), np.sort(np.array(expected[1], np.uint16)))
        at += len(expected[1])
    assert at == len(stream)


# -- filter audit


def audited(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    judged = collections.defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)}
        fails |= {"D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        judged[source or ""].append((frozenset(x for x in fails if fails[x]), i in good, i in toxic))
    out = []
    for part, rows in judged.items():
        shapley, lines = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                shapley[x] += len(gone)
                failing = [r for r in rows if x in r[0]]
                lines.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(r[0] == {x} for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        out += [tuple(line + [shapley[line[1][line[2] - 1]]]) for line in lines]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    docs = []
    for k in range(300):
        text = prose(rng, rng.choice([5, 49, 50, 51, 120]), words[: rng.choice([20, 150])])
        if rng.random() < 0.3:
            text += " " + "SHOUT" * rng.randint(1, 9)
        if rng.random() < 0.2:
            text = text.replace(" ", rng.choice(["# ", " \n", "  "]), 1)
        docs.append((k, text, rng.choice(["a", "b", None, ""])))
    docs += [(400 + k, docs[rng.randrange(30)][1], rng.choice("ab")) for k in range(60)]
    docs += [docs[0], docs[0], docs[7]] + [(i, t, "edge") for i, t in EDGES] + [(None, docs[3][1], "a"), (2, docs[290][1], "b"), (-1, docs[20][1], "c")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 500, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS part", "1 AS n")
    got = filter_audit.audit(table(spark, docs), said)
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, labels)
    assert filter_audit.audit(table(spark, docs).where("false"), said).count() == 0


def test_lattice():
    assert len(filter_audit.edges()) == 80 and len(filter_audit.steps()) == 600
    assert sum(ways for *_, ways in filter_audit.edges()) == 600
