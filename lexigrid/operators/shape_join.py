"""A join of shapes, multisets of weighted bigrams, by their weighted Jaccard similarity.

Units of equal shape are a class, of which the least ``unit_id`` stands for all.  Bigrams
are ordered by how few units have them.  Of two shapes that are similar the first
bigram that both have lies, in each, before what remains falls below the threshold's
share of its weight, so these prefixes meet in a bucket of that bigram.  Shapes of too
different a weight do not: buckets are cut by bands of weights, and two shapes whose
remaining weights can't add up to enough are no candidates.  These are proofs, so no
pair is lost; candidates are verified on whole shapes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .structure import idf

#: Shapes of a part of a bucket, on average at most.
PART = 4096
#: What sums may be off by rounding, as a share.
_SLACK = 1e-9


def shape_classes(shape: DataFrame) -> DataFrame:
    """``unit_id, rep``: the least unit of the same shape.  Units without a bigram are
    in no class."""
    one = F.array_sort(F.collect_list(F.struct("bigram", "n")))
    keys = shape.groupBy("unit_id").agg(F.sha2(F.to_json(one), 256).alias("key"))
    reps = materialize(keys.groupBy("key").agg(F.min("unit_id").alias("rep")), "shape-classes")
    return materialize(keys.join(reps, "key").select("unit_id", "rep"), "shape-members")


def weighed(shape: DataFrame, classes: DataFrame) -> DataFrame:
    """``unit_id, bigram, n, weight, df`` of representatives; the weights are those of
    all units, or 1 where there are too few to tell what is rare."""
    weights, _ = idf(shape)
    # Written, so that Spark can split the rows of a frequent bigram.
    held = materialize(weights.select("bigram", "df", F.coalesce("weight", F.lit(1.0)).alias("weight")), "shape-weights")
    reps = shape.select("unit_id", "bigram", "n").join(classes.where("unit_id = rep").select("unit_id"), "unit_id", "left_semi")
    return materialize(reps.join(held, "bigram").select("unit_id", "bigram", "n", "weight", "df"), "shapes")


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """``unit_id, bigram, total, rest``: bigrams before which a shape's similar ones
    have to share one; ``rest`` is the weight from this one on."""
    own = Window.partitionBy("unit_id")
    order = own.orderBy("df", "bigram").rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("n") * F.col("weight")
    placed = rows.withColumn("total", F.sum(x).over(own)).withColumn("rest", F.col("total") - F.coalesce(F.sum(x).over(order), F.lit(0.0)))
    return placed.where(F.col("rest") >= threshold * F.col("total") * (1 - _SLACK)).select("unit_id", "bigram", "total", "rest")


def candidates(rows: DataFrame, threshold: float, part: int = PART) -> DataFrame:
    """``i, j`` of representatives that may reach the threshold, each once."""
    width = max(-math.log(threshold) * (1 + _SLACK), 1e-6)
    held = prefixes(rows, threshold).withColumn("band", F.floor(F.log("total") / width))
    held = materialize(held, "shape-prefixes")
    crowded = held.groupBy("bigram", "band").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    crowded = materialize(crowded, "crowded")
    parts = F.coalesce("parts", F.lit(1))
    one = F.struct("unit_id", "total", "rest", F.col("band").alias("own"))
    cut = held.join(crowded, ["bigram", "band"], "left").withColumn("part", F.pmod(F.xxhash64("unit_id"), parts).cast("int"))
    # A similar shape lies in the same band or the next.
    dealt = held.select("bigram", one.alias("b"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    repeated = dealt.join(crowded, ["bigram", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    keys = ["bigram", "band", "part"]
    both = cut.select(*keys, one.alias("a")).join(repeated.select(*keys, "b"), keys)
    enough = threshold / (1 + threshold) * (F.col("a.total") + F.col("b.total")) * (1 - _SLACK)
    met = both.where((F.col("a.own") > F.col("b.own")) | (F.col("a.unit_id") < F.col("b.unit_id"))).where(F.least("a.rest", "b.rest") >= enough)
    return met.select(F.least("a.unit_id", "b.unit_id").alias("i"), F.greatest("a.unit_id", "b.unit_id").alias("j")).distinct()


def similar_shapes(shape: DataFrame, threshold: float, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """``i, j, structural`` of representatives with ``i < j`` that reach the threshold,
    and ``unit_id, rep`` of all units of ``shape(unit_id, bigram, n)``.

    The threshold is above 0 and at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"a threshold of {threshold} is not above 0 and at most 1")
    # Written, as it is read for classes, document frequencies and rows.
    known = materialize(shape.where("unit_id IS NOT NULL AND bigram IS NOT NULL AND n > 0").select("unit_id", "bigram", "n"), "shapes-known")
    classes = shape_classes(known)
    rows = weighed(known, classes)
    pairs = materialize(candidates(rows, threshold, part), "shape-candidates")
    sums = rows.groupBy("unit_id").agg(F.sum(F.col("n") * F.col("weight")).alias("total"))
    a = rows.select(F.col("unit_id").alias("i"), "bigram", F.col("n").alias("na"), "weight")
    b = rows.select(F.col("unit_id").alias("j"), "bigram", F.col("n").alias("nb"))
    both = pairs.join(a, "i").join(b, ["j", "bigram"]).groupBy("i", "j").agg(F.sum(F.least("na", "nb") * F.col("weight")).alias("both"))
    scored = both.join(sums.select(F.col("unit_id").alias("i"), F.col("total").alias("ti")), "i").join(sums.select(F.col("unit_id").alias("j"), F.col("total").alias("tj")), "j")
    similarity = F.col("both") / (F.col("ti") + F.col("tj") - F.col("both"))
    return scored.select("i", "j", similarity.alias("structural")).where(F.col("structural") >= threshold), classes


def links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``unit_id, rep, links``: how many other units are similar, equal ones included."""
    sizes = materialize(classes.groupBy("rep").agg(F.count("*").alias("members")), "shape-sizes")
    ends = pairs.select(F.col("i").alias("own"), F.col("j").alias("rep")).unionByName(pairs.select(F.col("j").alias("own"), F.col("i").alias("rep")))
    others = ends.join(sizes, "rep").groupBy("own").agg(F.sum("members").alias("others"))
    counted = sizes.join(others.withColumnRenamed("own", "rep"), "rep", "left").select("rep", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return classes.join(materialize(counted, "shape-links"), "rep").select("unit_id", "rep", "links")
