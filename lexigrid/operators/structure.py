"""Structural evidence: type bigrams, their rarity, and the four gates.

Units are described by the sequence of their node types in preorder.  A missing
signal is null, here and in every score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .numbering import numbered
from .vectors import Judge, similar_pairs

#: With fewer shaped units than this, rarity says nothing and is not used.
MIN_UNITS = 25


def shapes(nodes: DataFrame) -> DataFrame:
    """``unit_id, bigram, n`` from ``nodes(unit_id, pos, type)``."""
    order = Window.partitionBy("unit_id").orderBy("pos")
    pairs = nodes.withColumn("next", F.lead("type").over(order)).where("next IS NOT NULL")
    return pairs.groupBy("unit_id", F.concat_ws(" ", "type", "next").alias("bigram")).agg(F.count("*").alias("n"))


def shapes_of_arrays(units: DataFrame, types: str = "types") -> DataFrame:
    """The same from an array column, without a window."""
    t = F.col(types)
    n = F.size(t)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return units.select("unit_id", F.explode(pairs).alias("bigram")).groupBy("unit_id", "bigram").agg(F.count("*").alias("n"))


def idf(shape: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``bigram, df, weight`` and a one-row table ``units, norm``.

    Weights are null when there are too few units.
    """
    total = shape.agg(F.countDistinct("unit_id").alias("units"))
    total = total.withColumn("norm", F.when(F.col("units") >= MIN_UNITS, F.log((F.col("units") + 1) / F.lit(0.5))))
    df = shape.groupBy("bigram").agg(F.count("*").alias("df"))
    one_row = F.broadcast(total)
    weights = df.join(one_row, F.lit(True)).select(
        "bigram", "df", F.when(F.col("units") >= MIN_UNITS, F.log((F.col("units") + 1) / (F.col("df") + 0.5))).alias("weight")
    )
    return weights, total


def score_pairs(pairs: DataFrame, shape: DataFrame, weighted: bool = True) -> DataFrame:
    """``pairs(i, j, ...)`` with ``structural``, ``structural_plain``, ``distinct``.

    The union of two multisets is the sum of both less their intersection, so an
    inner join on shared bigrams is enough.
    """
    weights, total = idf(shape)
    s = shape.join(weights.select("bigram", "weight"), "bigram").select("unit_id", "bigram", "n", "weight")
    sums = s.groupBy("unit_id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("weight")).alias("wtotal"))
    keys = pairs.select("i", "j").distinct()
    a = s.select(F.col("unit_id").alias("i"), "bigram", F.col("n").alias("na"), "weight")
    b = s.select(F.col("unit_id").alias("j"), "bigram", F.col("n").alias("nb"))
    least = F.least("na", "nb")
    shared = (
        keys.join(a, "i").join(b, ["j", "bigram"]).groupBy("i", "j")
        .agg(F.sum(least).alias("both"), F.sum(least * F.col("weight")).alias("wboth"))
    )
    sa = sums.select(F.col("unit_id").alias("i"), F.col("total").alias("ta"), F.col("wtotal").alias("wa"))
    sb = sums.select(F.col("unit_id").alias("j"), F.col("total").alias("tb"), F.col("wtotal").alias("wb"))
    out = pairs.join(sa, "i", "left").join(sb, "j", "left").join(shared, ["i", "j"], "left").join(F.broadcast(total), F.lit(True), "left")
    signal = F.col("ta").isNotNull() & F.col("tb").isNotNull()
    both, wboth = F.coalesce("both", F.lit(0)), F.coalesce("wboth", F.lit(0.0))
    plain = F.when(signal, both / (F.col("ta") + F.col("tb") - both))
    wunion = F.col("wa") + F.col("wb") - wboth
    rare = F.when(signal & F.col("norm").isNotNull(), F.when(wunion > 1e-9, wboth / wunion).otherwise(0.0))
    distinct = F.when(signal & F.col("norm").isNotNull(), F.when(both > 0, wboth / both / F.col("norm")).otherwise(0.0))
    chosen = F.coalesce(rare, plain) if weighted else plain
    return out.select(
        *[f"`{c}`" for c in pairs.columns], chosen.alias("structural"), plain.alias("structural_plain"),
        (distinct if weighted else F.lit(None).cast("double")).alias("distinct"),
    )


def overlaps(a: str, b: str) -> Column:
    """Whether two units lie in one file with common lines."""
    return (
        (F.col(f"{a}.path") == F.col(f"{b}.path")) & (F.col(f"{a}.start") <= F.col(f"{b}.end")) & (F.col(f"{b}.start") <= F.col(f"{a}.end"))
    )


def calls(a: str, b: str) -> Column:
    """Whether one unit names the other."""
    def one(x: str, y: str) -> Column:
        return (F.col(f"{x}.name") != "") & F.array_contains(F.col(f"{y}.idents"), F.col(f"{x}.name"))

    return F.coalesce(one(a, b), F.lit(False)) | F.coalesce(one(b, a), F.lit(False))


def gate(
    pairs: DataFrame, units: DataFrame, shape: DataFrame, min_structure: float = 0.5, min_distinct: float = 0.10,
    filter_callers: bool = True, weighted: bool = True, located: bool = True,
) -> DataFrame:
    """Pairs that survive the gates, cheap ones first; no signal passes.

    ``units`` has ``unit_id, path, start, end, name, idents``.  Without ``located``
    overlapping lines are no reason to drop a pair.
    """
    held = units.select("unit_id", F.struct("path", "start", "end", "name", "idents").alias("u"))
    both = pairs.join(held.select(F.col("unit_id").alias("i"), F.col("u").alias("a")), "i").join(
        held.select(F.col("unit_id").alias("j"), F.col("u").alias("b")), "j"
    )
    if located:
        both = both.where(~overlaps("a", "b"))
    if filter_callers:
        both = both.where(~calls("a", "b"))
    scored = score_pairs(both.select(*[f"`{c}`" for c in pairs.columns]), shape, weighted)
    return scored.where(
        (F.col("structural").isNull() | (F.col("structural") >= min_structure))
        & (F.col("distinct").isNull() | (F.col("distinct") >= min_distinct))
    )


#: Entries of bags that a task compares at a time.
_ENTRIES = 1_000_000
_SCORES = "structural double, structural_plain double, distinct double"


def described(shape: DataFrame) -> tuple[DataFrame, float | None]:
    """``unit_id, grams, counts, weights`` of each shape as arrays in the order of the
    bigrams' numbers, and the norm of :func:`idf`."""
    shape = materialize(shape, "shapes")
    weights, total = idf(shape)
    # One row a bigram.
    named = materialize(numbered(weights, "gram", "bigram"), "bigrams")
    entry = F.struct("gram", F.col("n").alias("count"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    bags = shape.join(named, "bigram").groupBy("unit_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return bags.select("unit_id", F.col("e.gram").alias("grams"), F.col("e.count").alias("counts"), F.col("e.weight").alias("weights")), total.first()["norm"]


class _Bags:
    """The shapes of a task's rows, each different one once."""

    def __init__(self, table: pa.Table):
        columns = [table.column(c).combine_chunks() for c in ("grams", "counts", "weights")]
        size = np.asarray(columns[0].value_lengths().fill_null(0))
        grams, counts, weights = (c.flatten().to_numpy(zero_copy_only=False) for c in columns)
        end = np.cumsum(size)
        seen: dict[bytes, int] = {}
        first: list[int] = []
        self.of = np.empty(len(size), np.int64)
        for row, (s, e) in enumerate(zip((end - size).tolist(), end.tolist())):
            key = grams[s:e].tobytes() + counts[s:e].tobytes()
            if key not in seen:
                seen[key] = len(first)
                first.append(row)
            self.of[row] = seen[key]
        self.size = size[first]
        self.start = np.cumsum(self.size) - self.size
        at = np.repeat((end - size)[first] - self.start, self.size) + np.arange(self.size.sum())
        grams, self.counts, self.weights = grams[at], counts[at].astype(np.float64), weights[at]
        self.grams, self.width = grams, int(grams.max()) + 1 if len(grams) else 1
        owner = np.repeat(np.arange(len(first)), self.size)
        self.keys = owner * self.width + grams
        self.total = np.bincount(owner, self.counts, len(first))
        self.heavy = np.bincount(owner, self.counts * self.weights, len(first))

    def shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and weights of the intersections of different shapes."""
        both, heavy = np.zeros(len(a)), np.zeros(len(a))
        ends = np.cumsum(self.size[a])
        s = 0
        while s < len(a):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + _ENTRIES, "right")))
            size = self.size[a[s:e]]
            pair = np.repeat(np.arange(e - s), size)
            mine = np.repeat(self.start[a[s:e]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            if len(mine):
                wanted = b[s:e][pair] * self.width + self.grams[mine]
                other = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                least = np.where(self.keys[other] == wanted, np.minimum(self.counts[mine], self.counts[other]), 0.0)
                both[s:e] = np.bincount(pair, least, e - s)
                heavy[s:e] = np.bincount(pair, least * self.weights[mine], e - s)
            s = e
        return both, heavy

    def scores(self, a: np.ndarray, b: np.ndarray, norm: float | None, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :func:`score_pairs` gives them, for rows; NaN is no signal."""
        many = len(self.size)
        pairs, back = np.unique(self.of[a] * many + self.of[b], return_inverse=True)
        x, y = pairs // many, pairs % many
        both, heavy = self.shared(x, y)
        signal = (self.size[x] > 0) & (self.size[y] > 0)
        none = np.full(len(pairs), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            plain = np.where(signal, both / (self.total[x] + self.total[y] - both), none)
            union = self.heavy[x] + self.heavy[y] - heavy
            rare = np.where(signal, np.where(union > 1e-9, heavy / union, 0.0), none) if norm is not None else none
            distinct = np.where(signal, np.where(both > 0, heavy / both / norm, 0.0), none) if norm is not None else none
        chosen = rare if weighted and norm is not None else plain
        return chosen[back], plain[back], (distinct if weighted else none)[back]


def _said(structural: np.ndarray, plain: np.ndarray, distinct: np.ndarray) -> dict[str, pa.Array]:
    return {c: pa.array(v, pa.float64(), mask=np.isnan(v)) for c, v in (("structural", structural), ("structural_plain", plain), ("distinct", distinct))}


def similar_scored(vectors: DataFrame, threshold: float, shape: DataFrame, weighted: bool = True, **options) -> DataFrame:
    """:func:`score_pairs` of :func:`.vectors.similar_pairs`, scored where the vectors
    meet: shapes go along with them, and no pair is shuffled."""
    bags, norm = described(shape)

    def look(table: pa.Table) -> Callable:
        held = _Bags(table)
        return lambda a, b: (np.ones(len(a), bool), _said(*held.scores(a, b, norm, weighted)))

    return similar_pairs(vectors, threshold, judge=Judge(bags.withColumnRenamed("unit_id", "vec_id"), _SCORES, look), **options)


def _codes(*columns: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Numbers for strings, equal ones the same; null is -1."""
    held = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    known = pa.concat_arrays([c.cast(pa.large_string()) for c in held]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(known, np.cumsum([len(c) for c in held])[:-1])


def similar_gated(
    vectors: DataFrame, threshold: float, units: DataFrame, shape: DataFrame, min_structure: float = 0.5, min_distinct: float = 0.10,
    filter_callers: bool = True, weighted: bool = True, located: bool = True, **options,
) -> DataFrame:
    """:func:`gate` of :func:`.vectors.similar_pairs`, where the vectors meet: units go
    along with them, and pairs that do not pass leave no task."""
    bags, norm = described(shape)
    held = units.select(F.col("unit_id").alias("vec_id"), "path", F.col("start").cast("long"), F.col("end").cast("long"), "name", F.array_distinct("idents").alias("idents"), F.lit(True).alias("there"))
    held = held.join(bags.withColumnRenamed("unit_id", "vec_id"), "vec_id", "left")

    def look(table: pa.Table) -> Callable:
        own = _Bags(table)
        there = table.column("there").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        (path,) = _codes(table.column("path"))
        # Null is NaN, which is greater than nothing.
        start, end = (table.column(c).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        idents = table.column("idents").combine_chunks()
        empty, name, said = _codes(pa.array([""]), table.column("name"), idents.flatten())
        name = np.where(name == empty[0], -1, name)
        width = int(max(name.max(initial=0), said.max(initial=0))) + 1
        # Rows with what they name, in order.
        row = np.repeat(np.arange(len(table)), np.asarray(idents.value_lengths().fill_null(0)))
        named = np.sort(row[said >= 0] * width + said[said >= 0])

        def calls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if not len(named):
                return np.zeros(len(a), bool)
            wanted = b * width + name[a]
            return (name[a] >= 0) & (named[np.minimum(np.searchsorted(named, wanted), len(named) - 1)] == wanted)

        def judge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
            structural, plain, distinct = own.scores(a, b, norm, weighted)
            kept = np.flatnonzero(there[a] & there[b] & ~(structural < min_structure) & ~(distinct < min_distinct))
            x, y = a[kept], b[kept]
            good = np.ones(len(kept), bool)
            if located:
                good &= ((path[x] != path[y]) & (path[x] >= 0) & (path[y] >= 0)) | (start[x] > end[y]) | (start[y] > end[x])
            if filter_callers:
                good &= ~(calls(x, y) | calls(y, x))
            kept = kept[good]
            return kept, _said(structural[kept], plain[kept], distinct[kept])

        return judge

    return similar_pairs(vectors, threshold, judge=Judge(held, _SCORES, look), **options)
