"""Links between units that are told apart by their places only.

Units with the same text, name and shape pass or fail every gate together but that of
overlapping lines.  So classes of them are compared, and their members are linked by
the first and the last place of a class: any two that do not overlap stand one before
the other, and then the first is before the later one, and the earlier one before the
last.  That gives links that connect what all pairs would, as many as there are
members, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def copy_classes(units: DataFrame, *alike: str | Column) -> tuple[DataFrame, DataFrame]:
    """``cls, head, tail, members`` of classes and ``cls, unit_id, path, start, end`` of
    ``units``, of which those with equal ``alike``, null included, are a class.

    ``cls`` is the least ``unit_id``; ``head`` ends first and ``tail`` begins last, by
    path and line.
    """
    keyed = units.select("unit_id", "path", "start", "end", F.sha2(F.to_json(F.struct(*alike)), 256).alias("key"))
    classes = keyed.groupBy("key").agg(
        F.min("unit_id").alias("cls"), F.min(F.struct("path", F.col("end").alias("line"), "unit_id")).alias("head"),
        F.max(F.struct("path", F.col("start").alias("line"), "unit_id")).alias("tail"), F.count("*").alias("members"),
    )
    # Written, so that Spark can split the rows of a large class in the joins.
    classes = materialize(classes, "classes")
    members = materialize(keyed.join(classes.select("key", "cls"), "key").drop("key"), "members")
    return classes.drop("key"), members


def _before(path: str, line: str, other_path: str, other_line: str) -> Column:
    return (F.col(path) < F.col(other_path)) | ((F.col(path) == F.col(other_path)) & (F.col(line) < F.col(other_line)))


def _met(rows: DataFrame, side: str, rest: list[str]) -> DataFrame:
    """Pairs of the unit in ``rows`` with the first and last of the class ``side``."""
    early = F.when(_before("path", "end", f"{side}.tail.path", f"{side}.tail.line"), F.col(f"{side}.tail.unit_id"))
    late = F.when(_before(f"{side}.head.path", f"{side}.head.line", "path", "start"), F.col(f"{side}.head.unit_id"))
    met = rows.select("unit_id", F.explode(F.array_compact(F.array(early, late))).alias("other"), *rest)
    return met.select(F.least("unit_id", "other").alias("i"), F.greatest("unit_id", "other").alias("j"), *rest)


def located_pairs(pairs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of units ``i, j`` from pairs of classes ``i, j``, other columns kept.

    A class paired with itself links its members.  Units of one file whose lines
    overlap are no pair.  Every unit that has a partner in a pair of classes is linked,
    and what all pairs of members would connect is connected.
    """
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    ends = classes.select("cls", F.struct("head", "tail").alias("ends"))
    own = members.join(pairs.where("i = j").withColumnRenamed("i", "cls").drop("j"), "cls").join(ends.withColumnRenamed("ends", "x"), "cls")
    inside = materialize(_met(own, "x", ["cls", *rest]), "inside")
    # Members without a partner in their own class meet the others by themselves.
    held = inside.select("cls", F.explode(F.array("i", "j")).alias("unit_id")).distinct()
    loose = members.join(held, ["cls", "unit_id"], "left_anti")
    one = F.struct("cls", F.struct("head", "tail").alias("ends"))
    across = pairs.where("i <> j").join(classes.select(F.col("cls").alias("i"), one.alias("a")), "i").join(classes.select(F.col("cls").alias("j"), one.alias("b")), "j")
    across = materialize(across.select("i", "j", F.col("a.ends").alias("a"), F.col("b.ends").alias("b"), *rest), "across")
    found = [inside.select("i", "j", *rest)]
    for mine, other in (("i", "b"), ("j", "a")):
        head = F.col("a" if mine == "i" else "b")
        first = across.select(head["head"]["unit_id"].alias("unit_id"), head["head"]["path"].alias("path"), head["head"]["line"].alias("end"), F.col(other).alias("y"), *rest)
        early = first.where(_before("path", "end", "y.tail.path", "y.tail.line"))
        found.append(early.select(F.least("unit_id", "y.tail.unit_id").alias("i"), F.greatest("unit_id", "y.tail.unit_id").alias("j"), *rest))
        alone = loose.withColumnRenamed("cls", mine).join(across.select(mine, F.col(other).alias("y"), *rest), mine)
        found.append(_met(alone, "y", rest))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["i", "j"])
