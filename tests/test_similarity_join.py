"""The similarity join in blocks against brute force."""

import numpy as np
import pytest

from lexigrid.operators.vectors import _tiles, plan_join, similar_pairs


def vectors(seed, groups=12, each=40, dim=16, spread=0.02, unit=True, noise=60):
    """Groups of like vectors, copies, zeros, and one group much larger than others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = [c + spread * rng.normal(size=dim) for c in centres for _ in range(each)] + [centres[0] + spread * rng.normal(size=dim) for _ in range(5 * each)]
    rows += [rows[k] for k in range(0, len(rows), 9)] + [rng.normal(size=dim) for _ in range(noise)]
    rows = np.array(rows)
    if unit:
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return np.vstack((rows, np.zeros((3, dim)))).astype(np.float32)


def table(spark, rows):
    held = [(k, v.tolist()) for k, v in enumerate(rows)] + [(None, rows[0].tolist()), (9999, None)]
    return spark.createDataFrame(held, "vec_id long, embedding array<float>")


def expected(rows, threshold):
    first = {}
    for k, v in enumerate(rows):
        first.setdefault(tuple(v.tolist()), k)
    ids = np.array(sorted(first.values()))
    wide = rows[ids].astype(np.float64)
    a, b = np.nonzero(np.triu(wide @ wide.T >= threshold, 1))
    return set(zip(ids[a].tolist(), ids[b].tolist()))


@pytest.mark.parametrize("seed,threshold,unit", [(1, 0.97, True), (2, 0.4, True), (3, 0.97, False), (4, -0.1, True)])
def test_pairs(spark, seed, threshold, unit):
    rows = vectors(seed, unit=unit)
    got = similar_pairs(table(spark, rows), threshold, block=50, cell_rows=40)
    assert {(r["i"], r["j"]) for r in got.collect()} == expected(rows, threshold)
    assert {(r["i"], r["j"]) for r in similar_pairs(table(spark, rows), threshold).collect()} == expected(rows, threshold)


@pytest.mark.parametrize("noise,share", [(0, 0.7), (60, 0.5)])
def test_blocks_are_left_out_and_bounded(spark, noise, share):
    """Rows unlike all others widen the cells that they fall into."""
    rows = vectors(5, noise=noise)
    plan = plan_join(table(spark, rows), 0.97, block=50, cell_rows=40)
    sizes = [r["count"] for r in plan.rows.groupBy("block").count().collect()]
    assert max(sizes) < 100 and len(sizes) == plan.blocks and plan.skipped() > share
    # Nothing can be left out where everything may be similar.
    assert plan_join(table(spark, rows), -1.0, block=50, cell_rows=40).skipped() == 0


def test_equal_distances_are_split(spark):
    """Vectors that all lie on one ring of one cell."""
    rng = np.random.default_rng(6)
    rows = np.sign(rng.normal(size=(300, 24))).astype(np.float32) / np.float32(24**0.5)
    plan = plan_join(table(spark, rows), 0.5, block=40, cell_rows=10_000)
    assert max(r["count"] for r in plan.rows.groupBy("block").count().collect()) < 80
    assert {(r["i"], r["j"]) for r in similar_pairs(table(spark, rows), 0.5, block=40, cell_rows=10_000).collect()} == expected(rows, 0.5)


def test_no_rows(spark):
    none = table(spark, vectors(7)).where("false")
    assert similar_pairs(none, 0.5).count() == similar_pairs(none, 0.5, block=0 + 1).count() == 0
    plan = plan_join(none, 0.5)
    assert plan.blocks == 0 and plan.skipped() == 0


def test_small_blocks_meet_in_tiles(spark):
    """A row is sent once a tile, not once a block; what is left out stays so."""
    rows = vectors(8)
    plan = plan_join(table(spark, rows), 0.97, block=10, cell_rows=40)
    tiles = {r["block"]: r["tile"] for r in _tiles(plan.bounds, 200).collect()}
    sizes = {r["block"]: r["n"] for r in plan.bounds.collect()}
    held = {}
    for block, tile in tiles.items():
        held[tile] = held.get(tile, 0) + sizes[block]
    assert set(tiles) == set(sizes) and len(tiles) > 5 * len(held) > 5
    assert max(held.values()) < 200 + max(sizes.values())
    assert [tiles[b] for b in sorted(tiles)] == sorted(tiles.values())
    for tile_rows in (30, 200, 10_000):
        got = similar_pairs(table(spark, rows), 0.97, block=10, cell_rows=40, tile_rows=tile_rows).collect()
        assert len(got) == len({(r["i"], r["j"]) for r in got}) and {(r["i"], r["j"]) for r in got} == expected(rows, 0.97)
