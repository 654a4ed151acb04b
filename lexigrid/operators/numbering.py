"""Consecutive numbers in a given order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def numbered(df: DataFrame, name: str, *order, start: int = 0) -> DataFrame:
    """``df`` with a column ``name`` that counts from ``start`` in ``order``.

    Rows are ranged and sorted, and written once so that their places stay; the
    counts before each range are summed over one row a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # As many rows as ranges, and so as shuffle partitions.
    joined = held.join(F.broadcast(offsets), "_range")
    return joined.withColumn(name, F.col("_before") + F.col("_at") + start).drop("_range", "_at", "_before")
