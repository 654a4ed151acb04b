"""The inverted file against exact search."""

import numpy as np
import pytest

from lexigrid.operators.inverted import InvertedFile, build
from lexigrid.operators.vectors import top_k
from lexigrid.sources.scratch import fresh_path


def rows(seed, n=900, dim=18, groups=15):
    rng = np.random.default_rng(seed)
    held = rng.normal(size=(groups, dim))[rng.integers(groups, size=n)] + 0.5 * rng.normal(size=(n, dim))
    held[: n // 3] = held[0] + 0.3 * rng.normal(size=(n // 3, dim))  # a third of the rows in one place
    held /= np.linalg.norm(held, axis=1, keepdims=True)
    held[5:9] = held[4]
    return held.astype(np.float32)


def table(spark, held, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(held)], "vec_id long, embedding array<float>")


def asked(vectors):
    return vectors.where("vec_id % 20 = 4")


def result(found):
    return {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in found.collect()}


def recall(found, exact):
    near = {}
    for (q, _), (v, _) in exact.items():
        near.setdefault(q, set()).add(v)
    return sum(v in near[q] for (q, _), (v, _) in found.items()) / len(exact)


def test_recall_and_exactness(spark):
    vectors = table(spark, rows(1))
    index = build(spark, fresh_path(spark, "index"), vectors, part_rows=100)
    exact = result(top_k(vectors, asked(vectors), 10, min_score=-1.0))
    assert sorted(r["vec_id"] for r in index.rows().collect()) == list(range(900))
    assert index.rows().groupBy("cell", "part").count().agg({"count": "max"}).first()[0] < 160
    assert recall(result(index.search(asked(vectors), 10, min_score=-1.0)), exact) >= 0.9
    # Few cells and few candidates lose rows; what the bounds leave finds them.
    poor = recall(result(index.search(asked(vectors), 10, -1.0, probes=1, take=10)), exact)
    assert poor < 0.9
    assert result(index.search(asked(vectors), 10, -1.0, probes=1, take=10, exact=True)) == exact


def test_batches_versions_and_compaction(spark):
    held = rows(2)
    first, second = table(spark, held[:500]), table(spark, held[500:], 500)
    index = build(spark, fresh_path(spark, "index"), first)
    assert index.add(second.union(first)) == 400 and index.add(second) == 0
    both = first.union(second)
    exact = result(top_k(both, asked(both), 5))
    assert result(index.search(asked(both), 5, exact=True)) == exact
    assert result(index.search(asked(both), 5, exact=True, number=1)) == result(top_k(first, asked(both), 5))
    index.compact()
    assert index.versions() == [1, 2, 3]
    assert result(InvertedFile(spark, index.root).search(asked(both), 5, exact=True)) == exact


def test_nulls_empty_and_wrong_rows(spark):
    index = InvertedFile(spark, fresh_path(spark, "index"))
    none = spark.createDataFrame([(None, [1.0, 0.0]), (1, None)], "vec_id long, embedding array<float>")
    assert index.add(none) == 0 and index.search(none, 3).count() == 0
    one = spark.createDataFrame([(7, [1.0, 0.0], "x"), (7, [0.0, 1.0], "y")], "vec_id long, embedding array<float>, cell string")
    assert index.add(one) == 1
    assert result(index.search(one.limit(1), 3, min_score=-1.0, exact=True)) == {(7, 1): (7, 0.0)}
    assert index.search(none, 3).count() == 0
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(8, [1.0])], "vec_id long, embedding array<float>"))
