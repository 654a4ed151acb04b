"""The duplicate check of source code, from files to a report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators.components import clusters
from ..operators.copies import copy_classes, located_pairs
from ..operators.numbering import numbered
from ..operators.structure import gate, shapes_of_arrays
from ..operators.vectors import classes as vector_classes
from ..operators.vectors import similar_pairs
from ..sources import code, embed
from ..sources.files import list_sources
from ..sources.scratch import materialize
from . import report as R
from .settings import Job


def files(spark: SparkSession, job: Job) -> DataFrame:
    """Source files of a job, each once."""
    return list_sources(spark, job.include, job.extensions, tuple(job.exclude))


def units(spark: SparkSession, job: Job) -> DataFrame:
    """Numbered units of all files of a job."""
    found = code.extract(files(spark, job), job.min_lines, job.window_lines, job.window_overlap)
    return numbered(found, "unit_id", "path", "start", "end")


def check(found: DataFrame, job: Job, embedder: embed.Embedder | None = None, cache: embed.VectorCache | None = None, budget_bytes: int | None = None) -> DataFrame:
    """Gated pairs ``i, j, similarity, structural, distinct`` of units.

    Units of equal text, name and shape are a class, and classes are compared: copies
    are linked with the first and last of theirs, not each with each (see
    :mod:`..operators.copies`), so clusters are those of all pairs.  Classes of equal
    vectors are paired like others, with their own square as similarity.  With a cache
    only texts that it does not know are embedded.
    """
    embedder = embedder or embed.HashEmbedder()
    texts = found.withColumn("hash", embed.text_hash()).withColumn("pos", F.col("unit_id"))
    distinct = texts.dropDuplicates(["hash"])
    vectors = cache.fill(distinct, embedder) if cache else embed.embed(distinct, embedder)
    classes, members = copy_classes(texts, "hash", "name", "idents", "types")
    one = texts.select(F.col("unit_id").alias("cls"), "hash").join(classes.select("cls", "members"), "cls")
    held = materialize(one.join(vectors.select("hash", "vector"), "hash").select(F.col("cls").alias("vec_id"), F.col("vector").alias("embedding"), "members"), "vectors")
    base = similar_pairs(held.select("vec_id", "embedding"), job.threshold, **({"budget_bytes": budget_bytes} if budget_bytes else {}))
    alike = materialize(vector_classes(held.select("vec_id", "embedding")).select("vec_id", "rep", dot(F.col("embedding"), F.col("embedding")).alias("similarity")), "alike")
    a, b = alike.select(F.col("rep").alias("i"), F.col("vec_id").alias("a")), alike.select(F.col("rep").alias("j"), F.col("vec_id").alias("b"))
    across = base.join(a, "i").join(b, "j").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "similarity")
    near = alike.where(F.col("similarity") >= job.threshold)
    same = near.select("rep", F.col("vec_id").alias("i"), "similarity").join(near.select("rep", F.col("vec_id").alias("j")), "rep").where("i < j").select("i", "j", "similarity")
    own = near.join(held.where("members > 1").select("vec_id"), "vec_id").select(F.col("vec_id").alias("i"), F.col("vec_id").alias("j"), "similarity")
    shaped = found.where("types IS NOT NULL")
    gated = gate(
        across.unionByName(same).unionByName(own), found, shapes_of_arrays(shaped), job.min_structure, job.min_distinct, job.filter_callers,
        job.idf_weighting, located=False,
    ).drop("structural_plain")
    return located_pairs(materialize(gated, "gated"), classes, members)


def lines(
    spark: SparkSession, job: Job, embedder: embed.Embedder | None = None, cache: embed.VectorCache | None = None,
    say: Callable[[str], None] | None = None, budget_bytes: int | None = None,
) -> DataFrame:
    """``number, line`` of a report; ``say`` is told what was read and found, before
    any limit.  A task's similarities fit ``budget_bytes``, 0 or None for the usual
    bound.  :func:`.report.save` writes the lines in order, as a folder."""
    job.check()
    found = units(spark, job)
    counted = found.agg(F.countDistinct("path").alias("files"), F.count("*").alias("units")).first()
    if say:
        say(f"{counted['files']} files, {counted['units']} units")
    if counted["units"] < 2:
        raise ValueError("a duplicate check needs two units at least")
    pairs = materialize(check(found, job, embedder, cache, budget_bytes), "pairs")
    if say:
        say(f"{pairs.count()} pairs")
    if job.report == "clusters":
        groups = materialize(clusters(pairs.select(F.col("i").alias("a"), F.col("j").alias("b"))), "clusters")
        if say:
            say(f"{groups.select('cluster_id').distinct().count()} clusters")
        return R.cluster_report(groups, found, job.output, job.top_n)
    return R.pair_report(R.ranked(R.with_refs(pairs, found), job.top_n), job.output)


def stream(spark: SparkSession, job: Job, *args, **kwargs) -> Iterator[str]:
    """The lines of :func:`lines`, of which the driver holds a partition at a time."""
    held = materialize(lines(spark, job, *args, **kwargs), "report")
    return (r["line"] for r in held.sort("number").toLocalIterator())


def run(spark: SparkSession, job: Job, *args, **kwargs) -> list[str]:
    """A small report as a list of lines; one of pairs as JSON is one line."""
    held = list(stream(spark, job, *args, **kwargs))
    return ["".join(held)] if job.output == "json" and job.report != "clusters" else held
