"""Context, messages and history for grounded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SYSTEM = (
    "Answer from the excerpts that come with the question, and name the files that "
    "you used. Where they do not hold the answer, say that they do not."
)
PLAIN_SYSTEM = "You are a helpful assistant."
# What stands between blocks, and where there are none.
SEPARATOR = "\n\n---\n\n"
NOTHING = "(no matching context found in the local store)"


def context(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """``query_id, context, blocks, sources`` of ``hits(query_id, rank, score,
    path, text)``.

    Blocks are taken by rank until the first that would pass the budget;
    separators are not counted.  Sources name all hits.
    """
    block = F.concat(F.lit("[source: "), T.basename(F.col("path")), F.format_string(" | relevance %.2f]\n", "score"), F.col("text"))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = hits.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(order))
    held = F.when(F.col("used") <= budget, F.struct("rank", "block"))
    taken = F.array_sort(F.collect_list(held))
    return sized.groupBy("query_id").agg(
        F.array_join(F.transform(taken, lambda x: x["block"]), SEPARATOR).alias("context"),
        F.count(held).alias("blocks"),
        F.array_join(F.array_sort(F.collect_set(T.basename(F.col("path")))), ", ").alias("sources"),
    )


def messages(questions: DataFrame, system: str = SYSTEM, chat: bool = False) -> DataFrame:
    """``query_id, system, user`` of ``questions(query_id, question, context)``."""
    found = F.coalesce(F.col("context"), F.lit("")) != ""
    bare = F.col("question") if chat else F.concat(F.lit(NOTHING + "\n\nQuestion: "), F.col("question"))
    user = F.when(found, F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))).otherwise(bare)
    return questions.select("query_id", F.lit(system).alias("system"), user.alias("user"))


def history(turns: DataFrame, history_turns: int = 8, strict_zero: bool = False) -> DataFrame:
    """The last ``2 * history_turns`` messages of each conversation.

    Zero keeps everything, as a slice from minus nothing does, unless
    ``strict_zero``.
    """
    if history_turns == 0:
        return turns.where("false") if strict_zero else turns
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= 2 * history_turns).drop("_back")


def transcript(turns: DataFrame) -> DataFrame:
    """``conv_id, transcript``: messages by turn with a blank line between."""
    line = F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("transcript"))


def sse_text(lines: DataFrame) -> DataFrame:
    """``stream_id, content`` of the event lines of streamed answers.

    Lines that are no data, the end mark, broken JSON and events without choices
    add nothing.
    """
    data = lines.where(F.col("line").startswith("data:")).withColumn("payload", F.trim(F.substring("line", 6, 1 << 30)))
    # What follows the end mark of a stream is not read.
    stop = lines.where(F.trim(F.substring("line", 6, 1 << 30)) == "[DONE]").groupBy("stream_id").agg(F.min("pos").alias("stop"))
    data = data.join(stop, "stream_id", "left").where(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    piece = F.get_json_object("payload", "$.choices[0].delta.content")
    ordered = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("pos", piece.alias("piece")))))
    return data.groupBy("stream_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("content"))
