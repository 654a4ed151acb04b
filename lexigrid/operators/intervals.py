"""Joins of closed intervals of whole numbers that overlap, by equal keys.

An interval belongs to the level of the least power of two that is not below its
length, and lies in one or two bins of that width.  Two intervals that overlap share a
bin of the longer one's level, so shorter ones are dealt to the bins of the levels
above theirs that occur, at most two a level.  A bin is at most four times as long as
the intervals of its level: no length makes bins of many rows that do not touch.  Of
the bins that two intervals share the one counts where the later one starts.  A bin of
many short intervals is cut in parts, each of which meets the long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Shorter intervals that a part of a bin has, on average at most.
PART = 4096


def _levelled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as one struct ``key``, ``id, start, end`` and ``level``; nulls and empty
    intervals overlap nothing."""
    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "id", "start", "end"])).where("`start` <= `end`")
    # In doubles, for no length overflows them; a level that rounding changes costs a bin
    # more, and no pair.
    length = F.col("end").cast("double") - F.col("start").cast("double") + 1
    level = F.least(F.ceil(F.log2(length)).cast("int"), F.lit(63))
    return known.select(F.struct(*keys).alias("key"), "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), level.alias("level"))


def _bin(place: Column, level: Column) -> Column:
    return F.call_function("shiftright", place, level)


def _dealt(rows: DataFrame) -> DataFrame:
    """A row a bin at ``at``, which is in the row."""
    bins = F.sequence(_bin(F.col("start"), F.col("at")), _bin(F.col("end"), F.col("at")))
    return rows.withColumn("bin", F.explode(bins))


def _met(short: DataFrame, long: DataFrame, levels: list[int], equal: bool, part: int) -> DataFrame:
    """``short`` and ``long`` of two that overlap, where the second's level is greater,
    or with ``equal`` not less."""
    own = _dealt(long.withColumn("at", F.col("level")))
    above = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: (x >= F.col("level")) if equal else (x > F.col("level")))
    other = materialize(_dealt(short.withColumn("at", F.explode(above))), "intervals")
    # Only crowded bins have a row here.
    crowded = other.groupBy("key", "at", "bin").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    crowded = materialize(crowded, "crowded")
    parts = F.coalesce("parts", F.lit(1))
    cut = other.join(crowded, ["key", "at", "bin"], "left").withColumn("part", F.pmod(F.xxhash64("id", "start", "end"), parts).cast("int"))
    repeated = own.join(crowded, ["key", "at", "bin"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    one = F.struct("id", "start", "end", "level")
    both = cut.select("key", "at", "bin", "part", one.alias("short")).join(repeated.select("key", "at", "bin", "part", one.alias("long")), ["key", "at", "bin", "part"])
    first = F.greatest("short.start", "long.start")
    return both.where((F.col("short.start") <= F.col("long.end")) & (F.col("long.start") <= F.col("short.end")) & (_bin(first, F.col("at")) == F.col("bin")))


def _levels(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("level").distinct().collect())  # 64 at most


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """``i, j`` of all rows of ``left`` and ``right`` with equal ``keys`` and a common
    place; both have ``id, start, end``.  A repeated row is met each time."""
    a, b = materialize(_levelled(left, keys), "left"), materialize(_levelled(right, keys), "right")
    found = _met(b, a, _levels(a), True, part).select(F.col("long.id").alias("i"), F.col("short.id").alias("j"))
    return found.unionByName(_met(a, b, _levels(b), False, part).select(F.col("short.id").alias("i"), F.col("long.id").alias("j")))


def overlapping(rows: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """``i, j`` with ``i < j`` of all rows with equal ``keys`` and a common place.
    Rows of one ``id`` are no pair."""
    a = materialize(_levelled(rows, keys), "rows")
    both = _met(a, a, _levels(a), True, part).where("short.level < long.level AND short.id <> long.id OR short.level = long.level AND short.id < long.id")
    return both.select(F.least("short.id", "long.id").alias("i"), F.greatest("short.id", "long.id").alias("j"))
