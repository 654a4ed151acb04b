"""The join of shapes against all pairs."""

import math
import random
from collections import Counter

import pytest

from lexigrid.operators.shape_join import candidates, links, shape_classes, similar_shapes, weighed

SCHEMA = "unit_id long, bigram string, n long, rep string, df string"


def shapes(seed, units=120, words=40):
    """Variants of some shapes, copies, a bigram that all have, and rare ones."""
    r = random.Random(seed)
    base = [Counter({"all": 1, **{f"w{int(words * r.random() ** 2)}": r.randint(1, 4) for _ in range(12)}}) for _ in range(8)]
    held = {}
    for u in range(units):
        own = Counter(r.choice(base))
        for _ in range(r.randint(0, 4)):
            own[f"w{r.randrange(words)}"] += 1
        held[u] = dict(own)
    held[units] = {"alone": 5}
    return held


def table(spark, held):
    rows = [(u, b, n, "x", "y") for u, own in held.items() for b, n in own.items()]
    return spark.createDataFrame([*rows, (None, "w1", 3, "", ""), (777, None, 3, "", "")], SCHEMA)


def expected(held, t):
    df = Counter(b for own in held.values() for b in own)
    w = {b: math.log((len(held) + 1) / (d + 0.5)) if len(held) >= 25 else 1.0 for b, d in df.items()}
    reps = {}
    for u in sorted(held):
        reps.setdefault(tuple(sorted(held[u].items())), u)
    rep = {u: reps[tuple(sorted(own.items()))] for u, own in held.items()}

    def score(a, b):
        keys = set(held[a]) | set(held[b])
        least = sum(w[k] * min(held[a].get(k, 0), held[b].get(k, 0)) for k in keys)
        return least / sum(w[k] * max(held[a].get(k, 0), held[b].get(k, 0)) for k in keys)

    ids = sorted(reps.values())
    pairs = {(a, b): round(s, 9) for a in ids for b in ids if a < b and (s := score(a, b)) >= t}
    near = {u: sum(v != u and (rep[v] == rep[u] or tuple(sorted((rep[u], rep[v]))) in pairs) for v in held) for u in held}
    return pairs, rep, near


@pytest.mark.parametrize("seed,t,units", [(1, 0.7, 120), (2, 0.3, 120), (3, 0.95, 120), (4, 0.5, 10)])
def test_pairs_and_links(spark, seed, t, units):
    held = shapes(seed, units)
    wanted, rep, near = expected(held, t)
    for part in (8, 4096):
        pairs, classes = similar_shapes(table(spark, held), t, part)
        assert {(r["i"], r["j"]): round(r["structural"], 9) for r in pairs.collect()} == wanted
    got = {r["unit_id"]: (r["rep"], r["links"]) for r in links(pairs, classes).collect()}
    assert got == {u: (rep[u], near[u]) for u in held}


def test_fewer_candidates_than_pairs(spark):
    held = shapes(5)
    shape = table(spark, held).where("unit_id IS NOT NULL AND bigram IS NOT NULL")
    classes = shape_classes(shape)
    n = classes.select("rep").distinct().count()
    met = candidates(weighed(shape, classes), 0.8)
    assert len(expected(held, 0.8)[0]) <= met.count() < n * (n - 1) // 2 // 3


def test_no_rows_and_wrong_thresholds(spark):
    none = table(spark, {})
    pairs, classes = similar_shapes(none, 0.5)
    assert pairs.count() == classes.count() == links(pairs, classes).count() == 0
    with pytest.raises(ValueError):
        similar_shapes(none, 0.0)
