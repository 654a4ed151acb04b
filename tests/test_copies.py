"""The duplicate check of copies, overlaps and zero vectors against all pairs."""

import random

import numpy as np
import pytest

from lexigrid.operators.components import clusters
from lexigrid.plans import dupcheck
from lexigrid.plans.settings import Job
from lexigrid.sources.embed import HashEmbedder

UNITS = "unit_id long, path string, kind string, name string, start int, end int, text string, types array<string>, idents array<string>"
LOOSE = {"min_structure": 0.0, "min_distinct": 0.0}


def unit(k, path, start, end, text, name="", idents=(), types=None):
    return (k, path, "window", name, start, end, text, types, list(idents))


def all_pairs(units, threshold, callers=True):
    vectors = np.array(HashEmbedder().embed([u[6] for u in units]), np.float64)
    score = vectors @ vectors.T
    found = set()
    for x, a in enumerate(units):
        for y in range(x):
            b = units[y]
            if score[x, y] < threshold or (a[1] == b[1] and a[4] <= b[5] and b[4] <= a[5]):
                continue
            if callers and ((a[3] and a[3] in b[8]) or (b[3] and b[3] in a[8])):
                continue
            found.add((min(a[0], b[0]), max(a[0], b[0])))
    return found


def joined(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def checked(spark, units, threshold=0.9, **job):
    return dupcheck.check(spark.createDataFrame(units, UNITS), Job(threshold=threshold, **LOOSE, **job))


def test_units_that_overlap_in_a_chain(spark):
    units = [unit(0, "a", 1, 10, "same words"), unit(1, "a", 5, 15, "same words"), unit(2, "a", 11, 20, "same words")]
    assert {(r["i"], r["j"]) for r in checked(spark, units).collect()} == {(0, 2)}


def test_zero_vectors_are_like_nothing(spark):
    units = [unit(0, "a", 1, 9, " "), unit(1, "b", 1, 9, " "), unit(2, "c", 1, 9, "\t"), unit(3, "d", 1, 9, "x y"), unit(4, "e", 1, 9, "y x")]
    assert [(r["i"], r["j"], round(r["similarity"], 6)) for r in checked(spark, units).collect()] == [(3, 4, 1.0)]


@pytest.mark.parametrize("seed,callers", [(1, True), (2, False), (3, True)])
def test_links_connect_what_all_pairs_do(spark, seed, callers):
    """Copies in few files and many, beside and over each other, some of which call themselves."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(6)]
    texts += [" ".join(reversed(t.split())) for t in texts[:3]] + [t + " more" for t in texts[:4]] + [" "]
    units = []
    for k in range(120):
        start = rng.randint(1, 25)
        name = rng.choice(["", "", "f", "g"])
        units.append(unit(k, rng.choice("aab"), start, start + rng.randint(0, 14), rng.choice(texts), name, rng.choice([(), ("f",), ("h",)])))
    expected = all_pairs(units, 0.9, callers)
    got = {(r["i"], r["j"]) for r in checked(spark, units, filter_callers=callers).collect()}
    assert got <= expected and joined(got) == joined(expected)


def test_copies_are_linked_a_few_times_each(spark):
    units = [unit(k, f"f{k}", 1, 9, "copied text of a unit") for k in range(300)]
    pairs = checked(spark, units)
    assert pairs.count() < 2 * 300
    groups = clusters(pairs.selectExpr("i AS a", "j AS b")).collect()
    assert len(groups) == 300 and {(r["cluster_id"], r["cluster_size"]) for r in groups} == {(0, 300)}
