"""Operator 12: how five filters interact in every order of application.

A document is known by which filters it fails, one of 32 masks.  What a filter does
as the next one depends only on the set of those already applied, so the 120 orders
are paths through a lattice of 80 edges (applied subset, next filter).  Documents are
counted by part, mask and labels before any shuffle, the counts contribute to the
edges, and the 600 steps of all orders are read off the edges by a join.

Everything is DataFrame functions.  A part has at most 128 counts, 80 edges and 600
steps, whatever its documents; the tables of edges and steps are constants.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
#: A: least words; B: least percent of different words; C: most percent of capitals.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
_SPACE = " \t\n\x0b\x0c\r"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def edges() -> list[tuple[int, int, int]]:
    """``applied, next, ways``: every subset with a filter outside it, and the number
    of orders that pass along this edge."""
    return [
        (applied, 1 << k, math.factorial(n) * math.factorial(len(FILTERS) - 1 - n))
        for applied in range(1 << len(FILTERS)) for n in [applied.bit_count()] for k in range(len(FILTERS)) if not applied >> k & 1
    ]


def steps() -> list[tuple[str, int, int, int]]:
    """``filter_order, step, applied, next`` of every order."""
    return [
        ("".join(order), k + 1, sum(_bit(x) for x in order[:k]), _bit(order[k]))
        for order in itertools.permutations(FILTERS) for k in range(len(FILTERS))
    ]


def _own_failures() -> Column:
    """Mask of the filters A to D, which a text fails by itself, from ``text, w``."""
    n = F.size("w")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failed = {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("w")) < MIN_DISTINCT * n,
        "C": 100 * capitals.cast("long") > MAX_CAPITALS * F.length("text").cast("long"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    return sum((F.when(c, _bit(x)).otherwise(0) for x, c in failed.items()), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n``: rows of each id, part and set of failed filters.

    E fails where the same whole text has a smaller ``doc_id`` anywhere in the table;
    texts are told apart by SHA-256.  A null id is never smaller and never larger.
    """
    trimmed = F.trim("text", F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select("*", words.alias("w"))
    judged = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), _own_failures().alias("mask"))
    # Repeated rows are one before the shuffle.  Written, so that Spark can split the
    # rows of a frequent text or id in the joins.
    held = materialize(judged.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n")), "judged")
    firsts = held.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = materialize(firsts.where("first < last").select("key", "first"), "firsts")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mask = F.col("mask") + F.when(again, _bit("E")).otherwise(0)
    return held.join(firsts, "key", "left").select("doc_id", "part", mask.alias("mask"), "n")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley`` of every part, order and step, zeros included.

    Null texts are empty, a null source is the part ``''``; repeated rows count each.
    A document is good or toxic if any row of ``labels`` with its id says so; a row
    without an id has no labels.  Without documents there are no rows; other columns
    are not read.
    """
    found = materialize(failures(docs), "failures")
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    said = materialize(said, "labels")
    # Rows without an id, of which there may be many, have no key to be dealt by.
    nameless = found.where("doc_id IS NULL").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    named = found.where("doc_id IS NOT NULL").join(said, "doc_id", "left").select(
        "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    counts = named.unionAll(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))

    lattice = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("applied", "next", "ways"), e))) for e in edges()))
    at_edges = counts.select("*", F.explode(lattice).alias("e")).select("part", "mask", "n", "good", "toxic", "e.applied", "e.next", "e.ways")
    fails = F.col("mask").bitwiseAND(F.col("next")) != 0
    alive = F.col("mask").bitwiseAND(F.col("applied")) == 0

    def total(where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(0)).alias(name)

    summed = at_edges.groupBy("part", "applied", "next", "ways").agg(
        total(alive & ~fails, "kept"), total(alive & fails, "removed"), total(~alive & fails, "redundant"),
        total(F.col("mask") == F.col("next"), "unique_fails"),
        total(alive & fails & F.col("good"), "good_lost"), total(alive & fails & F.col("toxic"), "toxic_lost"),
    )
    # Sixteen edges a filter and part.
    summed = materialize(summed, "edges")
    shapley = summed.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("ways")).alias("shapley"))
    # 600 rows, a constant.
    paths = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, applied int, next int")
    out = summed.join(shapley, ["part", "next"]).join(F.broadcast(paths), ["applied", "next"])
    return out.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
