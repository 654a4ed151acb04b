"""Operator 1: near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of five words.  Each register holds
the least of one pseudo-random exponential per element, on a logarithmic scale
and truncated; registers of two sets merge by maximum and agree about as often
as the sets do.  Bands of registers make buckets, in a bucket the Jaccard
similarity is estimated by likelihood from how many registers are equal, larger
and smaller, and what may reach the threshold is verified on the full sets.

Documents with equal sets are one class with one representative, so copies are
never compared.  A bucket returns links that connect what belongs together, not
all pairs.  A bucket of very many members is first compared with a few of its own,
block by block; then only what that left outside its largest group meets all others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialize, texts
from .token_ids import slices
from .words import POWER, mix, word_hashes

SHINGLE = 5
#: Registers: BANDS x ROWS of them; their base, and the sketch's rate.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.005, 20.0, 65_534
#: Members of a bucket that are compared in one task; more are cut in blocks, which
#: first meet so many members of their bucket.
BLOCK, PIVOTS = 4096, 6
#: A pair is verified if its estimate is at most this much below the threshold,
#: five standard deviations of the estimate there.
MARGIN = 0.18

_SEEDS = np.random.default_rng(20_240_501).integers(1, 1 << 63, (2, REGISTERS), np.uint64)
_SEEDS[0] |= np.uint64(1)


def shingle_sets(values: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``shingle`` words, empty
    without words.

    A to Z are lower-cased; words are runs of bytes that are not ASCII white
    space; a text of fewer words than a shingle has one, its whole sequence.
    """
    word, bounds = word_hashes(values)
    bounds = bounds.tolist()
    n = max(0, len(word) - shingle + 1)
    rolling = np.zeros(n, np.uint64)
    for k in range(shingle):
        rolling = rolling * POWER + word[k : k + n]
    rolling = mix(rolling)
    out, a = [], 0
    for b in bounds:
        if b - a >= shingle:
            out.append(np.unique(rolling[a : b - shingle + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = h * POWER + word[k]
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    whole = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((REGISTERS, len(sets)), np.float64)
    for k in range(REGISTERS):
        h = ((whole ^ _SEEDS[1, k]) * _SEEDS[0, k]) >> np.uint64(32)
        least[k] = np.minimum.reduceat(h.astype(np.uint32), starts)
    least = -np.log1p(-(least + 0.5) / 2**32) / RATE
    value = np.floor(1 - np.log(least) / np.log(BASE))
    # Centred so that sets of one to 2^50 elements stay within the limits.
    return np.clip(value + LIMIT // 4, 0, LIMIT + 1).astype(np.uint16).T


def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, from registers larger in u, in v, equal."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0.0, 1.0, 41):
        j = most * share
        a, b = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
        fit = more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))
        better = fit > best
        best[better], at[better] = fit[better], j[better]
    return at


def sketch(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """``doc_id, n_shingles, set_key, registers, row_key``; key and registers are null
    for documents without words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, size=1 << 19):
                sets = shingle_sets(values)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                regs: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, row in zip(full, registers([sets[k] for k in full])):
                        keys[k], regs[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), row.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, len(values)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(regs, pa.binary()),
                        batch.column("row_key").slice(part.start, len(values)),
                    ],
                    ["doc_id", "n_shingles", "set_key", "registers", "row_key"],
                )

    row = (F.lit(None) if row is None else row).cast("long").alias("row_key")
    return texts(docs, row).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary, row_key long")


def _sets_of(docs: DataFrame) -> DataFrame:
    """``node, registers, shingles`` of ``docs(set_key, registers, text)``; rows with
    the text of another set, whose id they share, are left out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, size=1 << 19):
                raw = [s.tobytes() for s in shingle_sets(values)]
                own = batch.slice(part.start, len(values))
                right = [xxhash.xxh3_128_digest(r) == k for r, k in zip(raw, own.column("set_key").to_pylist())]
                rows = [own.column("set_key"), own.column("registers"), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["node", "registers", "shingles"]).filter(pa.array(right, pa.bool_()))

    return docs.mapInArrow(run, "node binary, registers binary, shingles binary")


def link_bucket(
    node: np.ndarray, side: np.ndarray, regs: np.ndarray, shingles: list[bytes], percent: int, known: np.ndarray | None = None
) -> list[tuple]:
    """Links that connect all members of a bucket that belong together.

    Every pair is either verified, or out of reach by its estimate, or connected
    already; those with equal ``known`` are connected from the start.  With two sides
    only pairs across them are looked at.
    """
    n = len(node)
    size = np.array([len(s) // 8 for s in shingles], np.int64)

    @functools.lru_cache(256)
    def members(k: int) -> frozenset[int]:
        return frozenset(np.frombuffer(shingles[k], np.uint64).tolist())

    root = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    links = []
    for k in range(n - 1):
        other = np.arange(k + 1, n)
        other = other[root[other] != root[k]]
        if side[k] != side[-1] or side[0] != side[-1]:
            other = other[side[other] != side[k]]
        # Sizes bound the similarity.
        small, large = np.minimum(size[other], size[k]), np.maximum(size[other], size[k])
        other = other[100 * small >= percent * large]
        if not len(other):
            continue
        same = (regs[other] == regs[k]).sum(1)
        near = same >= (percent / 100 - 0.28) * REGISTERS
        other, same = other[near], same[near]
        if not len(other):
            continue
        more = (regs[k] > regs[other]).sum(1)
        at = estimate(more, REGISTERS - same - more, same, np.full(len(other), size[k], float), size[other].astype(float))
        likely = at >= percent / 100 - MARGIN
        order = np.argsort(-at[likely], kind="stable")
        for o in other[likely][order].tolist():
            if root[o] == root[k]:
                continue
            both = len(members(k) & members(o))
            if 100 * both >= percent * (size[k] + size[o] - both):
                links.append((node[k], node[o]))
                root[root == root[o]] = root[k]
    return links


def _linked(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links inside the groups ``bucket, low, high`` of ``placed``, which
    has ``node, side, known`` too."""
    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "node"])
        regs = np.frombuffer(b"".join(group["registers"]), "<u2").reshape(len(group), REGISTERS)
        # Each alone, but for those that are known to belong together.
        known = group["known"].to_numpy() if group["known"].notna().all() else None
        found = link_bucket(group["node"].to_numpy(), group["side"].to_numpy(), regs, group["shingles"].tolist(), percent, known)
        return pd.DataFrame(found, columns=["a", "b"])

    return placed.join(sets, "node").groupBy("bucket", "low", "high").applyInPandas(link, "a binary, b binary")


def _large_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of buckets of more than BLOCK members, from ``node, bucket, members``.

    Every member meets PIVOTS of its bucket.  What these stars connect is one group;
    members outside their bucket's largest meet all the others.  So a group of copies
    costs its size, and only what is unlike it costs more.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    none = F.lit(None).cast("binary").alias("known")
    least = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = large.groupBy("bucket").agg(F.max("members").alias("members"), *least)
    pivots = pivots.select("bucket", "members", F.explode(F.array_distinct(F.array(*(F.col(f"p{k}.node") for k in range(PIVOTS))))).alias("node"))
    zero, one = F.lit(0), F.lit(1)
    stars = large.select("node", "bucket", own.alias("low"), zero.alias("high"), zero.alias("side"), none).unionAll(
        pivots.select("node", "bucket", F.explode(F.sequence(zero, blocks - 1)).alias("low"), zero.alias("high"), one.alias("side"), none)
    )
    links = materialize(_linked(stars, sets, percent), "stars")
    roots = components(links)
    labelled = large.join(roots, "node", "left").select("node", "bucket", "members", F.coalesce("root", "node").alias("known"))
    labelled = materialize(labelled, "labelled")
    groups = labelled.groupBy("bucket", "known").agg(F.count("*").alias("n"))
    largest = groups.groupBy("bucket").agg(F.max_by("known", F.struct("n", "known")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    both = labelled.join(largest.where("rest > 0"), "bucket")
    rest_blocks = F.ceil(F.col("rest") / BLOCK).cast("int")
    outside = both.where("known <> main").select(
        "node", "bucket", F.pmod(F.xxhash64("node"), rest_blocks).cast("int").alias("low"),
        F.explode(F.sequence(zero, blocks - 1)).alias("high"), zero.alias("side"), "known",
    )
    every = both.select(
        "node", "bucket", F.explode(F.sequence(zero, rest_blocks - 1)).alias("low"), own.alias("high"), one.alias("side"), "known"
    )
    return links.unionAll(_linked(outside.unionAll(every), sets, percent))


def near_duplicates(docs: DataFrame, percent: int = 80, row: Column | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, and ``row_key`` if
    ``row`` gives one.

    Documents whose sets have ``100 * |A & B| >= percent * |A | B|`` are linked;
    ``component_id`` is the least ``doc_id`` reachable by links and ``kept`` says
    that it is the row's own.  Null, empty and wordless texts have no shingles
    and no links.  A row with a null ``doc_id`` is not linked, has a null
    component and is kept.  Rows that share a ``doc_id`` are linked each by their own
    text, and all kept if the component is their own id.  An empty table gives an empty
    result; other columns are not read.
    """
    sketched = materialize(sketch(docs, row), "sketch")
    known = sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(
        known.groupBy("set_key").agg(F.min(F.struct("doc_id", "registers")).alias("x"), F.count("*").alias("copies"))
        .select("set_key", F.col("x.doc_id").alias("rep"), F.col("x.registers").alias("registers"), "copies"),
        "classes",
    )
    width = 2 * ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(F.col("registers").substr(i * width + 1, F.lit(width)), i),
    )
    # A class is known by its set's key, as rows of one id may be of several.
    banded = classes.select(F.col("set_key").alias("node"), F.explode(bands).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(
        F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")
    ).where("members > 1")
    # Bands that gather the same members are one bucket.
    buckets = buckets.groupBy("members", "who").agg(F.min("bucket").alias("bucket"))
    members = materialize(banded.join(buckets.select("bucket", "members"), "bucket").distinct(), "members")
    involved = members.select(F.col("node").alias("set_key")).distinct().join(classes.select("rep", "set_key", "registers"), "set_key")
    one = texts(docs).where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep").join(involved, "rep")
    sets = materialize(_sets_of(one.select("set_key", "registers", "text")).dropDuplicates(["node"]), "sets")
    alone = members.where(F.col("members") <= BLOCK).select(
        "node", "bucket", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"), F.lit(None).cast("binary").alias("known")
    )
    links = _linked(alone, sets, percent)
    if (members.agg(F.max("members")).first()[0] or 0) > BLOCK:
        links = links.unionAll(_large_links(members.where(F.col("members") > BLOCK), sets, percent))
    roots = components(links).withColumnRenamed("node", "set_key")
    held = classes.select("set_key", "rep", "copies").join(roots, "set_key", "left").where("copies > 1 OR root IS NOT NULL")
    held = held.select("set_key", F.coalesce("root", "set_key").alias("root"), "rep")
    least = held.groupBy("root").agg(F.min("rep").alias("component"))
    # Written, so that Spark can split the rows of a frequent set in the join.
    owner = materialize(held.select("set_key", "root").join(least, "root").select("set_key", "component"), "owners")
    names = ["row_key"] if row is not None else []
    out = sketched.select("doc_id", "n_shingles", "set_key", *names)
    # Rows without words, of which there may be many, have no key to be dealt by.
    empty = out.where("set_key IS NULL").withColumn("component", F.lit(None).cast("long"))
    out = out.where("set_key IS NOT NULL").join(owner, "set_key", "left").unionByName(empty)
    out = out.select("doc_id", "n_shingles", *names, F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
