"""Exact vector search and exact similarity join, by blocks of a matrix.

Both are exact.  Search holds the stated queries in blocks against every row; a
task keeps the best rows of each query before anything is shuffled.  The join
compares one representative of equal vectors with another, block against block;
members of a class are reported as members, not as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Queries and rows of a block, and the most queries, and bytes of their vectors in
#: double precision, that every task gets whole.
QUERY_BLOCK, CORPUS_BLOCK, MOST_BROADCAST, MOST_BYTES = 1024, 100_000, 20_000, 32 << 20
#: Queries and rows that are scored at once.
QUERY_TILE, ROW_TILE = 512, 2048


def block_rows(n: int, budget_bytes: int | None) -> int:
    """Rows of a block so that its similarities fit a budget; 0 or None: all."""
    if not budget_bytes:
        return max(n, 1)
    return max(1, min(n, budget_bytes // (4 * max(n, 1))))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


class _Best:
    """The k best rows of each query seen so far, in arrays; what is held besides is a
    tile of QUERY_TILE queries and ROW_TILE rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, min_score: float, metric: str):
        self.asked, self.vectors, self.k, self.min_score, self.metric = ids, vectors, k, min_score, metric
        self.scores, self.ids = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for q in range(0, len(self.asked) if self.k else 0, QUERY_TILE):
            part, scores, best = (x[q : q + QUERY_TILE] for x in (self.vectors, self.scores, self.ids))
            for r in range(0, len(rows), ROW_TILE):
                own, new = rows[r : r + ROW_TILE], ids[r : r + ROW_TILE]
                found = part @ own.T
                if self.metric == "distance":
                    found *= -2
                    found += (part * part).sum(1)[:, None]
                    found += (own * own).sum(1)[None, :]
                    np.maximum(found, 0.0, out=found)
                    found *= -0.5
                    found += 1
                # Only what reaches the score, and is no worse than the last one held.
                a, b = np.nonzero(found >= np.maximum(scores[:, -1], self.min_score)[:, None])
                if not len(a):
                    continue
                hit = np.unique(a)
                who = np.concatenate((np.repeat(hit, self.k), a))
                value = np.concatenate((scores[hit].ravel(), found[a, b]))
                what = np.concatenate((best[hit].ravel(), new[b]))
                order = np.lexsort((what, -value, who))
                who, value, what = who[order], value[order], what[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                kept = place < self.k
                scores[who[kept], place[kept]], best[who[kept], place[kept]] = value[kept], what[kept]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of what is held."""
        a, b = np.nonzero(self.scores > -np.inf)
        return self.asked[a], self.ids[a, b], self.scores[a, b]


def top_k(
    corpus: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0, metric: str = "cosine", most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the ``k`` best rows of each query.

    Both tables have ``vec_id`` and ``embedding`` (unit length).  Ties go to the
    lesser id; scores below ``min_score`` are dropped.  Null ids or vectors match
    nothing.  Up to ``most_broadcast`` queries, of MOST_BYTES at most, are sent to all
    tasks; more are dealt into blocks, each of which meets each block of the corpus in
    one task.
    """
    known = "vec_id IS NOT NULL AND embedding IS NOT NULL"
    asked = queries.where(known).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = corpus.where(known).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    one = asked.select(F.size("embedding")).first()
    most_broadcast = min(most_broadcast, MOST_BYTES // (8 * max(1, one[0] if one else 1)))
    few = asked.limit(most_broadcast + 1).collect()
    if len(few) <= most_broadcast:
        few.sort(key=lambda r: r[0])
        sent = corpus.sparkSession.sparkContext.broadcast((np.array([r[0] for r in few], np.int64), np.array([r[1] for r in few], np.float64)))

        def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Best(*sent.value, k, min_score, metric)
            for batch in batches:
                if len(batch):
                    held.add(batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.flat()], ["query_id", "vec_id", "score"])

        found = rows.mapInArrow(best, "query_id long, vec_id long, score double")
    else:
        blocks = -(-asked.count() // QUERY_BLOCK)
        parts = max(1, -(-rows.count() // CORPUS_BLOCK))
        dealt = asked.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("c"))
        held_rows = rows.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"))

        def meet(ask: pa.Table, own: pa.Table) -> pa.Table:
            held = _Best(ask.column("vec_id").to_numpy(), _matrix(ask.column("embedding").combine_chunks()), k, min_score, metric)
            for batch in own.to_batches(max_chunksize=ROW_TILE) if len(ask) else ():
                held.add(batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding")))
            return pa.table(dict(zip(("query_id", "vec_id", "score"), held.flat())))

        keys = [F.col("q").cast("long"), F.col("c").cast("long")]
        found = dealt.groupBy(*keys).cogroup(held_rows.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def classes(vectors: DataFrame) -> DataFrame:
    """``vec_id, rep``: the least id with the same vector."""
    known = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").withColumn("key", F.xxhash64("embedding"))
    reps = known.groupBy("key", "embedding").agg(F.min("vec_id").alias("rep"))
    return known.join(reps, ["key", "embedding"]).select("vec_id", "rep", "embedding")


#: Rows of a block of the join, at most, rows of the blocks that make a tile, and bytes
#: of similarities that a task holds.
JOIN_BLOCK, TILE_ROWS, JOIN_BYTES = 16_384, 32_768, 64 << 20
#: What single precision may be off, for unit vectors of up to some thousand numbers.
_SLACK = 1e-4
#: Pairs that are multiplied again at a time.
_PIECE = 100_000


#: Cells of the join at most, vectors that their centres are fitted on at most, and
#: rows that a cell has at least on average.
MOST_CELLS, CELL_SAMPLE, CELL_ROWS = 256, 8192, 4096
#: What a bound may be off by rounding.
_BOUND_SLACK = 1e-6


def _centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``k`` cells: each first one is drawn by its squared distance to those
    before, then by Lloyd's rounds.  They decide what is compared where, never whether."""
    rng = np.random.default_rng(17)
    centres, far = sample[:1], np.full(len(sample), np.inf)
    while len(centres) < min(k, len(sample)):
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(1))
        if not far.any():
            break
        centres = np.vstack((centres, sample[rng.choice(len(sample), p=far / far.sum())]))
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * sample @ centres.T, axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


@dataclass
class JoinPlan:
    """Rows in blocks, and the pairs of blocks that may hold similar rows."""

    rows: DataFrame
    pairs: DataFrame
    blocks: int
    bounds: DataFrame

    def skipped(self) -> float:
        """Share of the pairs of blocks that are not compared."""
        every = self.blocks * (self.blocks + 1) // 2
        return 1 - self.pairs.count() / every if every else 0.0


def plan_join(vectors: DataFrame, threshold: float, block: int = JOIN_BLOCK, cell_rows: int = CELL_ROWS) -> JoinPlan:
    """Blocks ``vec_id, embedding, block`` of representatives of equal vectors, and
    ``low, high`` of the pairs of blocks that the bounds do not rule out.

    A row belongs to the nearest of some centres, in there to a ring of distances from
    it, and where a ring has more rows than a block to a part of it.  Two rows of
    squares x and y have a product of at least the threshold only if their distance is
    at most the root of ``x + y - 2 threshold``, and the triangle inequality bounds the
    distance of rows of two rings from below; nor is a product greater than that of the
    lengths.  Both are proofs, so the join stays exact.
    """
    reps = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").cast("long").alias("vec_id"))
    reps = materialize(reps, "representatives")
    spark, n = reps.sparkSession, reps.count()
    cells = max(1, min(MOST_CELLS, n // cell_rows))
    # A bounded sample, spread by the hash of the id.
    sample = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CELL_SAMPLE if cells > 1 else 1).select("embedding").collect()
    centres = _centres(np.array([r[0] for r in sample], np.float64), cells) if sample else np.zeros((1, 0))
    sent = spark.sparkContext.broadcast(centres)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own, c = _matrix(batch.column("embedding")), sent.value
            cell = np.argmin((c * c).sum(1) - 2 * own @ c.T, axis=1)
            far = np.sqrt(((own - c[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(cell, pa.int64()), pa.array(far), pa.array((own * own).sum(1))],
                ["vec_id", "embedding", "cell", "far", "square"],
            )

    kind = reps.schema["embedding"].dataType.simpleString()
    placed = materialize(reps.select("vec_id", "embedding").mapInArrow(place, f"vec_id long, embedding {kind}, cell long, far double, square double"), "cells")
    # One row a cell.
    spans = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    width = F.greatest((F.col("high") - F.col("low")) / F.ceil(F.col("n") / block), F.lit(1e-9))
    rings = placed.join(F.broadcast(spans.select("cell", F.col("low").alias("from"), width.alias("width"))), "cell")
    rings = rings.withColumn("ring", F.floor((F.col("far") - F.col("from")) / F.col("width")).cast("long")).drop("from", "width")
    parts = rings.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    name = F.shiftleft("cell", 48) + F.shiftleft("ring", 20) + part
    rows = materialize(rings.join(parts, ["cell", "ring"]).select("vec_id", "embedding", "cell", "far", "square", name.alias("block")), "blocks")

    blocks = materialize(rows.groupBy("block").agg(F.min("cell").alias("cell"), F.min("far").alias("near"), F.max("far").alias("far"), F.max("square").alias("square"), F.count("*").alias("n")), "bounds")
    apart = np.sqrt(np.maximum(0, ((centres[:, None] - centres[None]) ** 2).sum(2)))
    # A pair of cells a row, of MOST_CELLS squared at most.
    between = spark.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(centres)) for j in range(len(centres))], "cell_a long, cell_b long, apart double")
    a = blocks.select(*(F.col(c).alias(f"{c}_a") for c in blocks.columns if c != "n"))
    b = blocks.select(*(F.col(c).alias(f"{c}_b") for c in blocks.columns if c != "n"))
    gap = F.greatest(
        F.col("apart") - F.col("far_a") - F.col("far_b"), F.col("near_a") - F.col("apart") - F.col("far_b"), F.col("near_b") - F.col("apart") - F.col("far_a"), F.lit(0.0)
    )
    reach = F.col("square_a") + F.col("square_b") - 2 * threshold + _BOUND_SLACK
    may = (gap <= _BOUND_SLACK) | (gap * gap <= reach)
    if threshold > 0:
        may &= F.sqrt(F.col("square_a")) * F.sqrt(F.col("square_b")) + _BOUND_SLACK >= threshold
    pairs = a.join(F.broadcast(between), "cell_a").join(b, "cell_b").where((F.col("block_a") <= F.col("block_b")) & may)
    pairs = materialize(pairs.select(F.col("block_a").alias("low"), F.col("block_b").alias("high")), "block-pairs")
    return JoinPlan(rows.select("vec_id", "embedding", "block"), pairs, blocks.count(), blocks.select("cell", "block", "n"))


@dataclass
class Judge:
    """What is said of similar rows where they meet, so that pairs need no joins.

    ``rows(vec_id, ...)`` go along with the vectors.  ``look(table)`` of a task's rows
    gives a function of places ``a, b`` in it, which says which of these pairs stay, and
    the values of ``columns`` for those.
    """

    rows: DataFrame
    columns: str
    look: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, pa.Array | np.ndarray]]]]


def similar_pairs(
    vectors: DataFrame, threshold: float, block: int = JOIN_BLOCK, budget_bytes: int = JOIN_BYTES, cell_rows: int = CELL_ROWS,
    judge: Judge | None = None, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``i, j, similarity`` of all pairs of representatives with ``i < j`` and
    similarity of at least the threshold; equal vectors have one representative.

    Neighbouring blocks are a tile, and a task holds two tiles and a slice of their
    similarities that fits the budget, whatever the table's size is; so a row is sent
    once a tile, however small blocks are.  Pairs of blocks that :func:`plan_join` rules
    out are not compared.  A slice is multiplied in single precision; what comes near
    the threshold is multiplied again in double.  Null ids or vectors are in no pair.
    """
    if vectors.count() <= block:  # one block, which meets itself
        known = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").cast("long").alias("vec_id"))
        none = F.lit(0).cast("long")
        rows = _described(known.select("vec_id", "embedding", none.alias("own")), judge)
        return _compared(rows.withColumns({"low_tile": none, "high_tile": none}), None, threshold, budget_bytes, judge)
    plan = plan_join(vectors, threshold, block, cell_rows)
    tiles = _tiles(plan.bounds, tile_rows)
    low, high = (tiles.select(F.col("block").alias(side), F.col("tile").alias(f"{side}_tile")) for side in ("low", "high"))
    met = materialize(plan.pairs.join(low, "low").join(high, "high"), "tile-pairs")
    # A row a pair of tiles, and one of its tiles.
    sides = met.select("low_tile", "high_tile").distinct().select(F.col("low_tile").alias("low_tile"), F.col("high_tile").alias("high_tile"), F.explode(F.array_distinct(F.array("low_tile", "high_tile"))).alias("tile"))
    rows = _described(plan.rows.join(tiles, "block").select("vec_id", "embedding", F.col("block").alias("own"), "tile"), judge)
    return _compared(rows.join(F.broadcast(sides), "tile").drop("tile"), met, threshold, budget_bytes, judge)


def _described(rows: DataFrame, judge: Judge | None) -> DataFrame:
    return rows.join(judge.rows, "vec_id", "left") if judge else rows


def _tiles(bounds: DataFrame, tile_rows: int) -> DataFrame:
    """``block, tile``: neighbouring blocks in the order of their names, which is that of
    cells, of ``tile_rows`` rows together and at most one block more."""
    own = Window.partitionBy("cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # One row a cell, of MOST_CELLS.
    cells = bounds.groupBy("cell").agg(F.sum("n").alias("rows")).select("cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("from"))
    at = F.col("from") + F.coalesce(F.sum("n").over(own), F.lit(0))
    return materialize(bounds.join(F.broadcast(cells), "cell").select("block", F.floor(at / tile_rows).cast("long").alias("tile")), "tiles")


def _compared(placed: DataFrame, met: DataFrame | None, threshold: float, budget_bytes: int, judge: Judge | None) -> DataFrame:
    """Pairs of the rows of two tiles, each row in its block ``own``, of which blocks
    ``low`` and ``high`` are compared; without ``met`` there is one block."""
    kinds = {"i": pa.int64(), "j": pa.int64(), "similarity": pa.float64()}
    look = judge.look if judge else lambda table: lambda a, b: (np.ones(len(a), bool), {})

    def compare(group: pa.Table, pairs: pa.Table | None = None) -> pa.Table:
        if not len(group):
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        group = group.sort_by("own")
        ids, own = group.column("vec_id").to_numpy(), group.column("own").to_numpy()
        matrix = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        single, judged = matrix.astype(np.float32), look(group)
        names, start = np.unique(own, return_index=True)
        end = np.append(start[1:], len(own))
        lows, highs = (np.searchsorted(names, pairs.column(c).to_numpy()) for c in ("low", "high")) if pairs else (np.zeros(1, int), np.zeros(1, int))
        found = []
        for one in np.unique(lows):
            others = np.sort(highs[lows == one])
            # Neighbouring blocks are a range of rows, which needs no copy.
            cut = np.flatnonzero(np.diff(others) > 1)
            for first, last in zip(others[np.append(0, cut + 1)], others[np.append(cut, len(others) - 1)]):
                right = single[start[first] : end[last]].T
                rows = block_rows(end[one] - start[one], max(4 * (end[one] - start[one]), budget_bytes * (end[one] - start[one]) // right.shape[1]))
                for at in range(start[one], end[one], rows):
                    a, b = np.nonzero(single[at : min(at + rows, end[one])] @ right >= threshold - _SLACK)
                    a, b = a + at, b + start[first]
                    # A block meets itself once.
                    once = (ids[a] < ids[b]) | ((own[a] != own[b]) & (ids[a] != ids[b]))
                    a, b = a[once], b[once]
                    scores = np.concatenate([np.einsum("ij,ij->i", matrix[a[k : k + _PIECE]], matrix[b[k : k + _PIECE]], dtype=np.float64) for k in range(0, len(a), _PIECE)] or [np.zeros(0)])
                    near = scores >= threshold
                    a, b, scores = a[near], b[near], scores[near]
                    kept, said = judged(np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a))
                    a, b = a[kept], b[kept]
                    found.append(pa.table({"i": np.minimum(ids[a], ids[b]), "j": np.maximum(ids[a], ids[b]), "similarity": scores[kept], **said}))
        return pa.concat_tables(found)

    columns = ", ".join(["i long, j long, similarity double", *([judge.columns] if judge else [])])
    kinds |= {f.split()[0]: {"double": pa.float64(), "long": pa.int64()}[f.split()[1]] for f in columns.split(", ")}
    keys = ["low_tile", "high_tile"]
    if met is None:
        return placed.groupBy(*keys).applyInArrow(lambda group: compare(group), columns)
    return placed.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(compare, columns)
