"""Exact search against brute force, and what a task of it holds."""

import tracemalloc

import numpy as np
import pytest

from lexigrid.operators import vectors
from lexigrid.operators.vectors import top_k


@pytest.mark.parametrize("metric,most_broadcast", [("cosine", 100), ("distance", 100), ("cosine", 3)])
def test_best_rows(spark, metric, most_broadcast):
    """Ties go to the lesser id; what is below the score is dropped."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(90, 6))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.vstack((rows, rows[:40], rows[:9]))[rng.permutation(139)]
    held = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + [(None, rows[0].tolist()), (999, None)], "vec_id long, embedding array<double>")
    asked = held.where("vec_id % 9 = 0")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in top_k(held, asked, 5, 0.6, metric, most_broadcast).collect()}
    want = {}
    for q in range(0, 139, 9):
        # Equal vectors have equal scores but for rounding.
        score = np.round(rows @ rows[q], 9)
        best = [k for k in np.lexsort((np.arange(139), -score)) if score[k] >= 0.6][:5]
        want |= {(q, n + 1): (k, score[k]) for n, k in enumerate(best)}
    assert {k: s for k, (_, s) in got.items()} == pytest.approx({k: s for k, (_, s) in want.items()})
    assert {k: v for k, (v, _) in got.items()} == {k: v for k, (v, _) in want.items()}


def test_memory_of_many_queries():
    """A batch of 10,000 rows meets thousands of queries in tiles."""
    rng = np.random.default_rng(4)
    queries, rows = rng.normal(size=(3000, 8)), rng.normal(size=(10_000, 8))
    tracemalloc.start()
    held = vectors._Best(np.arange(3000), queries, 4, 0.0, "distance")
    held.add(np.arange(10_000), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    query, _, score = held.flat()
    square = ((queries[:50, None] - rows[None]) ** 2).sum(2)
    best = np.sort(1 - square / 2, axis=1)[:, ::-1][:, :4]
    assert score[query < 50] == pytest.approx(best[best >= 0])
