"""Operator 13: Jaccard join of word n-grams by adaptive multi-match prefixes.

A document's tokens are its distinct shingles, in one order for all documents: by
hash, but those that very many documents begin with come last.  With ``t`` the least
tokens that a document of ``n`` shares with anything similar, its first
``n - t + l`` tokens hold at least ``l`` of those shared, whatever ``l`` up to ``t``
is.  Each document chooses its own ``l`` by what its candidates are expected to cost:
a longer prefix is read more, but only what shares ``l`` tokens of it is verified.
Two documents are compared at the lesser ``l`` of both.

Documents with equal sets are one class.  Tokens are met within bands of sizes.  The classes with a token are paired if they
are few; more meet in blocks, where sizes and parity bitmaps, which bound the overlap
from above, leave out most pairs.  Very many meet a few of their own first, those are
verified and joined, and then only members outside a token's largest group meet the
others.  What is left is counted, held against the bitmaps where it was not yet, and
verified on full sets, which are made of no other documents.  So nothing is lost, and a
group of near copies costs its size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialize, texts
from .near_dedup import shingle_sets
from .token_ids import slices

SHINGLE = 3
#: Most tokens that a prefix has to share, and spare tokens that are looked at for
#: each prefix in case that some come last.
LEVELS, SPARE = 4, 8


class Sizes(NamedTuple):
    """Where groups are treated in another way, which changes no result."""

    #: A token that more windows hold comes last.
    hot: int = 1024
    #: Classes of a token that are paired.
    few: int = 16
    #: Members of a block of a larger group.
    block: int = 2048
    #: Members that all of a larger group meet first, and with how many of these one
    #: is verified.
    pivots: int = 4
    stars: int = 3
    #: Classes of a token of which no more meet in blocks at once.
    starred: int = 64


#: Bits of the table by which texts and tokens are looked up: 2 MB.
MARKS = 1 << 24
#: Tokens read in a verification for each that is read in a prefix.
VERIFY = 1 / 16


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """Least tokens that a set of ``n`` shares with a similar one."""
    return -(-percent * n // 100)


def window_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that are looked at first of a set of ``n``."""
    return np.minimum(n, n - least_shared(n, percent) + LEVELS + SPARE)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(v) for v in values]))
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, text_key, first_tokens, parities`` of every row;
    the key of the set is null without words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, size=1 << 19):
                sets = shingle_sets(values, SHINGLE)
                n = np.array([len(s) for s in sets], np.int64)
                windows = [s[:w] for s, w in zip(sets, window_size(n, percent).tolist())]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                bits = pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, len(values)), pa.array(n), pa.array(keys, pa.binary()), batch.column("text_key").slice(part.start, len(values)), _lists(windows), bits],
                    ["doc_id", "n_shingles", "set_key", "text_key", "first_tokens", "parities"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, text_key long, first_tokens array<long>, parities binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("text_key", F.xxhash64("text"))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of how many tokens fall on each of as many bits as there are tokens,
    rounded up to a power of two."""
    bits = max(256, 1 << (len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, tokens`` of the classes ``wanted(node, rep, text_key)``, each from one
    row with that id and text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, size=1 << 19):
                sets = shingle_sets(values, SHINGLE)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(part.start, len(values)), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["node", "n", "tokens"])

    keys = ["rep", "text_key"]
    wanted = materialize(wanted.select("node", *keys), "wanted")
    place = F.pmod(F.xxhash64("rep"), F.lit(MARKS))
    named = _keyed(docs).where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep")
    rows = named.where(_marked(wanted.select(place.alias("p")))(place)).join(wanted, keys)
    return rows.dropDuplicates(keys).select("node", "text").mapInArrow(run, "node long, n long, tokens array<long>")


def _marks(places: DataFrame) -> Broadcast:
    """A table of MARKS bits, of which those at ``places(p)`` are set, for the tasks."""
    words = places.select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    # At most MARKS / 64 rows.
    held, table = words.toArrow(), np.zeros(MARKS >> 6, np.int64)
    table[held.column("w").to_numpy()] = held.column("v").to_numpy()
    return places.sparkSession.sparkContext.broadcast(table)


def _marked(places: DataFrame) -> Callable[[Column], Column]:
    """Whether a place below MARKS is one of ``places(p)``.  It keeps most texts that
    are not asked for out of a join, and none that is."""
    sent = _marks(places)

    @F.pandas_udf("boolean")
    def marked(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((sent.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return marked


def _met(classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """``node, n, width, pos, token`` of ``tokens(token)`` in the windows of classes;
    most others are left out before anything is shuffled."""
    sent = _marks(tokens.select(F.pmod("token", F.lit(MARKS)).alias("p")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("first_tokens")
            width, token = held.value_lengths().to_numpy().astype(np.int64), held.flatten().to_numpy()
            owner, place = np.repeat(np.arange(len(width)), width), token & (MARKS - 1)
            at = np.flatnonzero(sent.value[place >> 6] >> (place & 63) & 1)
            own = owner[at]
            pos = at - (np.cumsum(width) - width)[own]
            columns = (batch.column("node").to_numpy()[own], batch.column("n").to_numpy()[own], width[own], pos, token[at])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "n", "width", "pos", "token"])

    rows = classes.select("node", "n", "first_tokens").mapInArrow(run, "node long, n long, width long, pos long, token long")
    return rows.join(tokens, "token")


def choose(n: np.ndarray, window: np.ndarray, owner: np.ndarray, pos: np.ndarray, df: np.ndarray, percent: int, hot_over: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set's ``l``, and each token's level: the least ``l`` whose prefix holds it.

    Tokens are those of ``owner``'s window that others hold too, by ``owner, pos``.
    """
    t = least_shared(n, percent)
    most = np.minimum(LEVELS, t)
    hot = df > hot_over
    before = np.cumsum(hot) - hot
    starts = np.searchsorted(owner, np.arange(len(n)))
    base = np.append(before, np.count_nonzero(hot))[starts]
    before = before - base[owner]
    cool = window - np.bincount(owner[hot], minlength=len(n))
    rank = np.where(hot, cool[owner] + before, pos - before)
    level = np.maximum(1, rank - (n - t)[owner] + 1)
    # What the tokens of each level, and of those below it, bring to be read.
    inside = level <= most[owner]
    read = np.zeros((len(n), LEVELS))
    np.add.at(read, (owner[inside], level[inside] - 1), df[inside])
    read = np.cumsum(read, axis=1)
    # Who shares l tokens was read l times.
    cost = read * (1 + VERIFY * n[:, None] / np.arange(1, LEVELS + 1))
    cost[np.arange(LEVELS) >= most[:, None]] = np.inf
    return np.argmin(cost, axis=1) + 1, level


def _prefixes(seen: DataFrame, percent: int, hot: int) -> DataFrame:
    """``node, n, need, level, token`` of the prefixes from ``node, n, width, pos,
    token, df``; ``need`` is the set's ``l``.  Without a ``width`` the rows of a set
    are its window, and their places follow from their order."""
    names = ["node", "n", "need", "level", "token"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held = batch.column("n").to_numpy(), batch.column("held")
            counts = held.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(n)), counts)
            flat = held.flatten()
            pos, token, df = (flat.field(k).to_numpy() for k in range(3))
            width = batch.column("width")
            if width.null_count:
                width, pos = counts, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            else:
                width = width.to_numpy()
            need, level = choose(n, width, owner, pos, df, percent, hot)
            kept = level <= need[owner]
            own = owner[kept]
            nodes = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[own], n[own], need[own], level[kept], token[kept])], names)

    lists = seen.groupBy("node", "n", "width").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "df"))).alias("held"))
    return lists.mapInArrow(run, "node long, n long, need long, level long, token long")


def prefixes(docs: DataFrame, classes: DataFrame, percent: int, hot: int) -> DataFrame:
    """``node, n, need, level, token`` of every class's prefix; tokens that nothing
    else can share may be left out."""
    width = F.size("first_tokens").cast("long").alias("width")
    spread = classes.select("node", "n", width, F.posexplode("first_tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    often = materialize(spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    seen = materialize(spread.join(often, "token").select("node", "n", "width", "pos", "token", "df"), "seen")
    # Windows with too many tokens that come last do not hold the prefix.
    t = F.ceil(F.lit(percent) * F.col("n") / 100)
    wanted = F.col("n") - t + F.least(F.lit(LEVELS), t)
    short = seen.where(F.col("df") > hot).groupBy("node", "n", "width").agg(F.count("*").alias("last"))
    short = materialize(short.where((F.col("width") < F.col("n")) & (F.col("width") - F.col("last") < wanted)).select("node", "width"), "short")
    if short.isEmpty():
        return _prefixes(seen, percent, hot)
    # Of these sets, all tokens that do not come last, and of those that do the
    # window's, are enough: together they are no fewer than the window.
    last = materialize(often.where(F.col("df") > hot), "last")
    whole = _whole_sets(docs, classes.join(short.select("node"), "node")).join(short, "node")
    whole = whole.select("node", "n", "width", F.posexplode("tokens").alias("pos", "token")).join(last, "token", "left").where("df IS NULL OR pos < width")
    whole = whole.select("node", "n", F.lit(None).cast("long").alias("width"), F.col("pos").cast("long").alias("pos"), "token", F.coalesce("df", F.lit(1).cast("long")).alias("df"))
    begun = materialize(_prefixes(whole, percent, hot), "begun")
    # Tokens of theirs that others may hold in their windows, each alone.
    late = materialize(begun.select("token").distinct().join(often, "token", "left_anti"), "late")
    met = _met(classes, late).withColumn("df", F.lit(1).cast("long")).select(*seen.columns)
    held = seen.unionAll(met).join(short.select("node"), "node", "left_anti")
    return _prefixes(held, percent, hot).unionAll(begun)


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Parities of each ``x`` and ``y`` that differ, on the lesser number of bits."""
    out = np.zeros(len(x), np.int64)
    sizes = np.array([[len(p), len(q)] for p, q in zip(x, y)]).reshape(-1, 2)
    for w, v in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (w, v)).all(1))
        bits = [_folded(np.frombuffer(b"".join(side[k] for k in at), np.uint64).reshape(len(at), -1), min(w, v) // 8) for side in (x, y)]
        out[at] = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
    return out


def most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """Most tokens that only one of two similar sets has, of ``total`` in both."""
    return total - 2 * -(-percent * total // (100 + percent))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar; those whose parities are too
    far apart are left out first, and texts are read of the others alone."""
    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            apart = _apart(batch.column("parities_a").to_pylist(), batch.column("parities_b").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most_apart(total, percent)))

    def of(rows: DataFrame, side: str, *columns: str) -> DataFrame:
        return rows.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))

    looked = pairs.join(of(classes, "a", "n", "parities"), "a").join(of(classes, "b", "n", "parities"), "b")
    looked = materialize(looked.mapInArrow(near, "a long, b long"), "near")
    nodes = looked.select(F.col("a").alias("node")).union(looked.select("b")).distinct()
    sets = materialize(_whole_sets(docs, classes.join(nodes, "node")), "sets")
    both = looked.join(of(sets, "a", "tokens"), "a").join(of(sets, "b", "tokens"), "b")
    both = both.select("a", "b", F.size("tokens_a").alias("x"), F.size("tokens_b").alias("y"), F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both"))
    return both.where(100 * F.col("both").cast("long") >= percent * (F.col("x") + F.col("y") - F.col("both")).cast("long")).select("a", "b")


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parities on fewer bits."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def possible_pairs(left: dict, right: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both sides that may be similar and are not known to be connected.

    A side has ``node, n, known, outside, parities``.  Rows of the right side that are
    also on some left side meet those of greater ``node`` only.
    """
    found = [np.zeros((2, 0), np.int64)]
    widths = [np.array([len(p) for p in side["parities"]]) for side in (left, right)]
    for w in np.unique(widths[0]).tolist():
        for v in np.unique(widths[1]).tolist():
            if max(w, v) > 2 * min(w, v) and percent > 50:  # sizes differ by more than a similar set's do
                continue
            rows, cols = np.flatnonzero(widths[0] == w), np.flatnonzero(widths[1] == v)
            bits = [np.frombuffer(b"".join(side["parities"][at]), np.uint64).reshape(len(at), -1) for side, at in ((left, rows), (right, cols))]
            x, y = (_folded(b, min(w, v) // 8) for b in bits)
            n, known, node, out = (right[c][cols] for c in ("n", "known", "node", "outside"))
            for k, row in enumerate(rows.tolist()):
                m = left["n"][row]
                ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (known != left["known"][row]) & (node != left["node"][row])
                at = np.flatnonzero(ok & (~out | (node > left["node"][row])))
                at = at[np.bitwise_count(x[k] ^ y[at]).sum(1, dtype=np.int64) <= most_apart(n[at] + m, percent)]
                found.append(np.stack((np.full(len(at), row), cols[at])))
    return tuple(np.concatenate(found, axis=1))


def _block_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """``a, b, weight, need`` from blocks ``group, low, high`` of two sides; ``weight``
    is of the tokens in the group that both prefixes share.  Rows of side 2 are on the
    second, and those outside on the first too."""
    def meet(block: pa.Table) -> pa.Table:
        sides, side = [], block.column("side").to_numpy()
        first = (side == 0) | ((side == 2) & block.column("outside").to_numpy())
        for held in (first, side > 0):
            part = block.filter(pa.array(held)).combine_chunks()
            side = {c: part.column(c).to_numpy() for c in ("node", "n", "need", "known", "outside")}
            parities = np.empty(len(part), object)
            parities[:] = part.column("parities").to_pylist()
            sides.append(side | {"parities": parities, "marks": part.column("marks")})

        @functools.cache
        def marks(k: int, row: int) -> dict[int, tuple]:
            return {m["bucket"]: (m["level"], m["own"], m["weight"]) for m in sides[k]["marks"][row].as_py()}

        found = []
        for x, y in zip(*(at.tolist() for at in possible_pairs(*sides, percent))):
            need = min(sides[0]["need"][x], sides[1]["need"][y])
            one, other = marks(0, x), marks(1, y)
            both = ((one[b], other[b]) for b in one.keys() & other.keys())
            weight = sum(p[2] for p, q in both if max(p[0], q[0]) <= need and (p[1] or q[1]))
            if weight:
                i, j = sides[0]["node"][x], sides[1]["node"][y]
                found.append((min(i, j), max(i, j), weight, need))
        columns = np.array(found, np.int64).reshape(-1, 4).T
        return pa.table(dict(zip(("a", "b", "weight", "need"), columns)))

    return placed.groupBy("group", "low", "high").applyInArrow(meet, "a long, b long, weight long, need long")


def _large_groups(large: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """Verified links of stars, of buckets with very many classes, and ``a, b, weight,
    need`` of what may be similar besides, of buckets with many.

    Buckets with the same first pivot, which all hold it, are one group.
    """
    least = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "n")).alias(f"p{k}") for k in range(sizes.pivots)]
    pivots = materialize(large.where("own").groupBy("bucket").agg(F.max("members").alias("members"), *least), "pivots")
    most = F.col("members") > sizes.starred
    every = F.array_distinct(F.array(*(F.struct(f"p{k}.node", f"p{k}.n") for k in range(sizes.pivots))))
    stars = pivots.where(most).select("bucket", F.explode(every).alias("p")).select("bucket", F.col("p.node").alias("b"), F.col("p.n").alias("m"))
    near = large.where(most).join(stars, "bucket").where((F.col("node") != F.col("b")) & _similar_sizes(F.col("n"), F.col("m"), percent))
    order = Window.partitionBy("node").orderBy(F.desc("shared"), "b")
    stars = near.groupBy("node", "b").agg(F.sum("weight").alias("shared")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sizes.stars)
    stars = materialize(stars.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), "star-pairs")
    links = materialize(_verified(stars, docs, classes, percent), "stars")

    placed = large.join(pivots.select("bucket", F.col("p0.node").alias("group")), "bucket")
    marked = placed.groupBy("group", "node", "n", "need").agg(F.collect_list(F.struct("bucket", "level", "own", "weight")).alias("marks"))
    labelled = marked.join(components(links), "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root")
    labelled = materialize(labelled, "labelled")
    groups = labelled.groupBy("group", "known").agg(F.count("*").alias("c"))
    largest = groups.groupBy("group").agg(F.max_by("known", F.struct("c", "known")).alias("main"), F.sum("c").alias("members"), (F.sum("c") - F.max("c")).alias("rest"))
    largest = materialize(largest.where("rest > 0"), "largest")
    both = labelled.join(largest, "group").withColumn("outside", F.col("known") != F.col("main"))
    both = both.join(classes.select("node", "parities"), "node")
    zero = F.lit(0)
    blocks, rest_blocks = (F.ceil(F.col(c) / sizes.block).cast("int") for c in ("members", "rest"))
    columns = ["group", "node", "n", "need", "known", "outside", "parities", "marks"]

    def own(count: Column) -> Column:
        return F.pmod(F.xxhash64("node"), count).cast("int")

    # A group of one block is sent once.
    first = both.where("outside").where(blocks > 1).select(*columns, own(rest_blocks).alias("low"), F.explode(F.sequence(zero, blocks - 1)).alias("high"), zero.alias("side"))
    second = both.select(*columns, F.explode(F.sequence(zero, rest_blocks - 1)).alias("low"), own(blocks).alias("high"), F.when(blocks > 1, 1).otherwise(2).alias("side"))
    return links, _block_pairs(first.unionAll(second), percent)


def join(docs: DataFrame, percent: int = 90, sizes: Sizes = Sizes()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Documents whose sets of SHINGLE words have ``100 * |A & B| >= percent * |A | B|``
    are linked; ``component_id`` is the least ``doc_id`` reachable by links.  Null,
    empty and wordless texts have no shingles and no links; a row with a null
    ``doc_id`` is not linked and has a null component.  Rows that share a ``doc_id``
    are linked each by their own text.  An empty table gives an empty result; other
    columns are not read.
    """
    sketched = materialize(sketch(docs, percent), "sketch")
    known = sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    rep = F.min(F.struct("doc_id", "text_key", "n_shingles", "first_tokens", "parities")).alias("x")
    classes = known.groupBy("set_key").agg(rep, F.count("*").alias("copies")).select(
        "set_key", F.col("x.doc_id").alias("rep"), "x.text_key", F.col("x.n_shingles").alias("n"), "x.first_tokens", "x.parities", "copies"
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links = materialize(_links(docs, classes, percent, sizes), "links")

    roots = components(links)
    held = classes.select("node", "set_key", "rep", "copies").join(roots, "node", "left").where("copies > 1 OR root IS NOT NULL")
    held = held.select("set_key", F.coalesce("root", "node").alias("root"), "rep")
    least = held.groupBy("root").agg(F.min("rep").alias("component"))
    # Written, so that Spark can split the rows of a frequent set in the join.
    owner = materialize(held.select("set_key", "root").join(least, "root").select("set_key", "component"), "owners")
    out = sketched.select("doc_id", "n_shingles", "set_key")
    # Rows without words, of which there may be many, have no key to be dealt by.
    empty = out.where("set_key IS NULL").withColumn("component", F.lit(None).cast("long"))
    out = out.where("set_key IS NOT NULL").join(owner, "set_key", "left").unionByName(empty)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _links(docs: DataFrame, classes: DataFrame, percent: int, sizes: Sizes) -> DataFrame:
    """``a, b``: links that connect all classes that belong together."""
    rows = materialize(_banded(prefixes(docs, classes, percent, sizes.hot), percent), "prefixes")
    who = F.sum(F.xxhash64("node", "need", "level", "own").cast("decimal(38,0)")).alias("who")
    groups = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.max("own").alias("any_own"), who).where("members > 1 AND any_own")
    # Tokens of the same members are one bucket.
    buckets = groups.groupBy("members", "who").agg(F.min("bucket").alias("bucket"), F.count("*").alias("weight"))
    buckets = materialize(buckets.select("bucket", "members", "weight"), "buckets")
    placed = materialize(rows.join(buckets, "bucket"), "placed")
    few, large = placed.where(F.col("members") <= sizes.few), placed.where(F.col("members") > sizes.few)

    a, b = few.alias("a"), few.alias("b")
    levels = F.greatest("a.level", "b.level") <= F.least("a.need", "b.need")
    meet = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & levels & (F.col("a.own") | F.col("b.own")) & _similar_sizes(F.col("a.n"), F.col("b.n"), percent)
    pairs = a.join(b, meet).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.weight").alias("weight"), F.least("a.need", "b.need").alias("need"))
    links = None
    if not large.isEmpty():
        # A pair may share tokens of both kinds.  With too few of the first kind it is
        # one of large groups too, or nothing.
        links, more = _large_groups(large, docs, classes, percent, sizes)
        pairs = pairs.unionAll(more)
    found = _verified(materialize(_enough(pairs), "candidates"), docs, classes, percent)
    return found if links is None else links.unionAll(found)


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` of prefixes dealt by token and band of sizes, into their ``own`` bucket
    and that of the next band, as similar sizes are at most one band apart."""
    # A little wider than the ratio of similar sizes, for what logarithms are off.
    width = -math.log(percent / 100) * (1 + 1e-9) + 1e-12
    band = F.floor(F.log(F.col("n").cast("double")) / width)
    both = F.explode(F.array(*(F.struct((band + k).alias("band"), F.lit(k == 0).alias("own")) for k in range(2)))).alias("x")
    return rows.select("node", "n", "need", "level", "token", both).select("node", "n", "need", "level", F.xxhash64("token", "x.band").alias("bucket"), "x.own")


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs that share as many tokens of their prefixes as they need."""
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")
