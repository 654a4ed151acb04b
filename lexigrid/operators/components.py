"""Connected components of an edge table, by large and small stars.

Before each round every task joins what its own edges connect, a bounded number of
them at a time.  That settles small tables at once and shortens long chains.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): neighbours are hung on the least node.

    A node's least neighbour comes from an aggregate that combines before the
    shuffle, so a node with very many neighbours is not gathered anywhere; it is
    written, so that Spark can split such a node's rows in the join.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = materialize(least, "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = hung.unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


#: Edges that a task joins at a time.
PIECE = 250_000


def _joined(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the same, from each node to the least that is seen
    with it in one piece of a partition."""
    def roots(u: list, v: list) -> pd.DataFrame:
        parent: dict = {}
        for a, b in zip(u, v):
            for x in (a, b):
                parent.setdefault(x, x)
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
        out = []
        for x in parent:
            root = x
            while parent[root] != root:
                root = parent[root]
            if root != x:
                out.append((x, root))
        return pd.DataFrame(out, columns=["u", "v"])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u: list = []
        v: list = []
        for batch in batches:
            u += batch["u"].tolist()
            v += batch["v"].tolist()
            if len(u) >= PIECE:
                yield roots(u, v)
                u, v = [], []
        if u:
            yield roots(u, v)

    return edges.mapInPandas(run, edges.schema)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``; root is the least node.

    Every round is written to the shared folder, so a lost executor costs one
    round.  Without edges the result is empty.
    """
    def written(rows: DataFrame) -> tuple[DataFrame, tuple]:
        held = materialize(rows, "edges")
        return held, tuple(held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # A shuffle first: a task that makes edges in Python does not hold a second worker
    # that joins them.
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = written(_joined(pairs))
    for _ in range(max_rounds):
        before = mark
        now, mark = written(_star(_star(_joined(now), True), False))
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def clusters(edges: DataFrame) -> DataFrame:
    """``cluster_id, node, cluster_size`` of groups of two or more nodes; ordered
    by size, then first member, when sorted by ``-cluster_size, cluster_id``."""
    roots = components(edges)
    sizes = roots.groupBy("root").agg(F.count("*").alias("cluster_size"))
    return roots.join(sizes, "root").select(F.col("root").alias("cluster_id"), "node", "cluster_size")
