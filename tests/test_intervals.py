"""Overlap joins against all pairs."""

import random
from collections import Counter

from lexigrid.operators.intervals import overlap_join, overlapping

SCHEMA = "path string, lang string, id long, start long, end long, bin string, level string"


def rows(seed, n=400, first=0):
    """Lengths from one to millions, one hot file with a crowded place, negative places."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        hot = r.random() < 0.4
        start = r.randint(-50, 50) if hot else r.randint(-5000, 5000)
        length = r.choice([1, 1, 2, 3, 8, 9, 100, 4096, 4097, 3_000_000])
        out.append(("hot" if hot else r.choice("abc"), r.choice(["x", "y"]), first + k, start, start + length - 1, "extra", "extra"))
    out += [("a", "x", first + n, 5, 4, "", ""), (None, "x", first + n + 1, 0, 9, "", ""), ("a", "x", None, 0, 9, "", ""), ("a", "x", first + n + 2, None, 9, "", "")]
    return out


def known(r):
    return None not in r[:5] and r[3] <= r[4]


def meet(x, y):
    return x[:2] == y[:2] and x[3] <= y[4] and y[3] <= x[4]


def test_self_join(spark):
    held = rows(1)
    expected = Counter((x[2], y[2]) for x in held for y in held if known(x) and known(y) and x[2] < y[2] and meet(x, y))
    for part in (10, 4096):
        got = overlapping(spark.createDataFrame(held, SCHEMA), ["path", "lang"], part=part)
        assert Counter((r["i"], r["j"]) for r in got.collect()) == expected


def test_two_tables_with_repeated_rows(spark):
    a, b = rows(2, 200), rows(3, 300)
    a += a[:5]
    b += b[:7]
    expected = Counter((x[2], y[2]) for x in a for y in b if known(x) and known(y) and meet(x, y))
    for part in (10, 4096):
        got = overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["path", "lang"], part=part)
        assert Counter((r["i"], r["j"]) for r in got.collect()) == expected


def test_extremes_and_no_rows(spark):
    far = 2**62
    held = [("a", "x", 1, -far, far, "", ""), ("a", "x", 2, far, far, "", ""), ("a", "x", 3, far - 1, far + 5, "", ""), ("a", "x", 4, -far - 1, -far - 1, "", "")]
    got = overlapping(spark.createDataFrame(held, SCHEMA), ["path"])
    assert {(r["i"], r["j"]) for r in got.collect()} == {(1, 2), (1, 3), (2, 3)}
    none = spark.createDataFrame([], SCHEMA)
    assert overlapping(none, ["path"]).count() == overlap_join(none, none, ["path"]).count() == 0
