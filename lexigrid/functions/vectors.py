"""Vector functions as Spark columns; arithmetic is in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda p, q: p + q)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    divisor = F.when(n == 0, 1.0).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / divisor)


def distance_score(distance: Column) -> Column:
    """Cosine of unit vectors from their distance."""
    return 1 - distance * distance / 2


def pack(vector: Column) -> Column:
    """A vector as little-endian single-precision bytes, for interchange."""
    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return packed(vector)


def unpack(raw: Column) -> Column:
    """The vector of :func:`pack`."""
    @F.pandas_udf("array<float>")
    def unpacked(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return unpacked(raw)
