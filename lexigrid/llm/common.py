"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path, materialize, shared_dir

__all__ = ["fresh_path", "materialize", "read_table", "shared_dir", "texts"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra) -> DataFrame:
    """``doc_id`` and ``text`` (null texts become empty), other columns pruned."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *extra,
    )
