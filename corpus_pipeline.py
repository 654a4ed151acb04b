"""A corpus pipeline of five stages, each the whole of its operator.

A stage takes the documents that the one before kept and returns documents; the
last returns packed pieces.  Every stage's result is written to the shared folder
and read again, so a lost executor costs work of one stage at most.

In every stage null ids are kept, null texts are empty, other columns stay whatever
their names, and an empty table gives an empty one.  A verdict holds for a row, not
for its id: rows that share an id are told apart by their texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import decontamination, near_dedup, packing, substring_dedup, toxicity
from lexigrid.llm.common import materialize, read_table
from lexigrid.llm.queries import END_ID, TOKENIZER

#: Similarity of near duplicates in percent, and bytes of a repeated passage or,
#: where its words are short, its words.
SIMILAR, REPEATED_BYTES, REPEATED_WORDS = 80, 250, 51


def _row_key() -> Column:
    """A row's id and text as one number."""
    return F.xxhash64("doc_id", "text")


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key is in the column ``key`` (``left_semi``) or not (``left_anti``)."""
    name = "key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, _row_key())
    # Written, so that Spark can split the rows of a frequent key in the join.
    keys = materialize(keys.select(F.col("key").alias(name)).distinct(), "keys")
    return keyed.join(keys, name, how).select(*(f"`{c}`" for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; null and empty texts
    are not, and each of repeated rows is judged alike."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Of repeated rows, alike in id and text, one stays; rows of one id with other
    texts stay or go by their own; rows without words or id stay.
    """
    verdicts = near_dedup.near_duplicates(docs, SIMILAR, row=_row_key()).select("doc_id", "n_shingles", "kept", F.col("row_key").alias("key"))
    verdicts = materialize(verdicts, "verdicts")
    repeated = verdicts.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    gone = verdicts.where("NOT kept").select("key")
    if repeated.isEmpty():
        return _matched(docs, gone, "left_anti")
    repeated = materialize(repeated.select("key"), "repeated")
    several = _matched(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return _matched(docs, gone.unionAll(repeated), "left_anti").unionAll(several)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat anywhere, in another row or
    the same; ``n_chars`` follows the text.  Repeated rows lose what they share."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring_dedup.remove_repeats(docs, REPEATED_BYTES, keep=rest, as_text=True, words=REPEATED_WORDS)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, those without an id included; each of
    repeated rows is judged alike."""
    leaks = decontamination.find_leaks(docs.select(_row_key().alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return _matched(docs, leaks.select(F.col("doc_id").alias("key")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences; a null or empty text is one
    piece, its end token, and repeated rows are packed each."""
    pieces = packing.cut_pieces(docs, public_tokenizers.path(TOKENIZER), END_ID)
    packed = packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL cannot express the classifier, the sketches or the tokenizer.
ORACLE_SQL = None
