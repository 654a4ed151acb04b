"""Reports of pairs and clusters as text, Markdown or JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.numbering import numbered

# Suffixes by output format.
SUFFIX = {"text": ".txt", "json": ".json", "markdown": ".md"}
ACCEPTED = {"text": (".txt", ".text"), "json": (".json",), "markdown": (".md", ".markdown")}
PAIR_HEAD = {
    "text": (),
    "markdown": ("| similarity | structural | distinct | a | b |", "|---|---|---|---|---|"),
    "json": ('{"pairs":[',),
}
PAIR_END = {"json": ("]}",)}


def with_refs(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs(i, j, ...)`` with the two units as structs ``a`` and ``b``."""
    held = units.select("unit_id", F.struct("path", "start", "end", "name", "kind").alias("u"))
    return pairs.join(held.select(F.col("unit_id").alias("i"), F.col("u").alias("a")), "i").join(
        held.select(F.col("unit_id").alias("j"), F.col("u").alias("b")), "j"
    )


def ranked(pairs: DataFrame, top_n: int | None = None) -> DataFrame:
    """Most similar first, ties by unit; ``top_n`` of 0 or None keeps all."""
    order = pairs.orderBy(F.desc("similarity"), "i", "j")
    return order.limit(top_n) if top_n else order


def _ref(u: str) -> Column:
    return T.ref(F.col(f"{u}.path"), F.col(f"{u}.start"), F.col(f"{u}.end"), F.col(f"{u}.name"))


def pair_line(output: str) -> Column:
    s, t, d = F.format_string("%.3f", "similarity"), T.three_places(F.col("structural")), T.three_places(F.col("distinct"))
    if output == "markdown":
        return F.concat(F.lit("| "), F.concat_ws(" | ", s, t, d), F.lit(" | `"), _ref("a"), F.lit("` | `"), _ref("b"), F.lit("` |"))
    return F.concat(s, F.lit("  struct "), t, F.lit("  distinct "), d, F.lit("  "), _ref("a"), F.lit("  <->  "), _ref("b"))


def pair_json() -> Column:
    """A pair as JSON; scores have four places, ties to even, and null is no signal."""
    return F.to_json(
        F.struct(
            F.bround("similarity", 4).alias("similarity"), F.bround("structural", 4).alias("structural"),
            F.bround("distinct", 4).alias("distinctiveness"), F.col("a"), F.col("b"),
        ),
        {"ignoreNullFields": "false"},
    )


def pair_report(pairs: DataFrame, output: str) -> DataFrame:
    """``number, line`` of a report, most similar pair first; a row a line, so that no
    task holds a whole report.  The lines of JSON are one object together."""
    at = numbered(pairs, "number", F.desc("similarity"), "i", "j")
    body = F.concat(F.when(F.col("number") > 0, ",").otherwise(""), pair_json()) if output == "json" else pair_line(output)
    head, end = PAIR_HEAD[output], PAIR_END.get(output, ())
    fixed = [(k - len(head), line) for k, line in enumerate(head)] + [((1 << 62) + k, line) for k, line in enumerate(end)]
    return at.select("number", body.alias("line")).unionByName(pairs.sparkSession.createDataFrame(fixed, "number long, line string"))


def cluster_report(members: DataFrame, units: DataFrame, output: str = "text", top_n: int | None = None) -> DataFrame:
    """``number, line``: each cluster's title and members, largest cluster first."""
    lines = cluster_lines(members, units, output)
    if top_n:
        lines = lines.where(F.col("number") <= top_n)
    title = ("### Cluster %d (%d matches)") if output == "markdown" else "cluster %d (%d matches):"
    titles = lines.select("number", "cluster_size").distinct()
    titles = titles.select("number", F.lit(-1).cast("long").alias("node"), F.format_string(title, "number", "cluster_size").alias("line"))
    both = lines.select("number", F.col("node").cast("long").alias("node"), "line").unionByName(titles)
    return numbered(both.withColumnRenamed("number", "cluster"), "number", "cluster", "node").select("number", "line")


def cluster_lines(members: DataFrame, units: DataFrame, output: str = "text") -> DataFrame:
    """``number, line`` of each member, largest cluster first."""
    held = units.select("unit_id", T.ref(F.col("path"), F.col("start"), F.col("end"), F.col("name")).alias("ref"))
    order = members.select("cluster_id", "cluster_size").distinct()
    ranked_clusters = numbered(order, "number", F.desc("cluster_size"), "cluster_id", start=1)
    mark = (F.lit("- `"), F.lit("`")) if output == "markdown" else (F.lit("  "), F.lit(""))
    return members.join(ranked_clusters.select("cluster_id", "number"), "cluster_id").join(held, F.col("node") == F.col("unit_id")).select(
        "number", "cluster_size", "node", F.concat(mark[0], "ref", mark[1]).alias("line")
    )


def report_path(path: str, output: str) -> str:
    """A report's name with the suffix of its format: a suffix that fits stays,
    that of another format is swapped, and any other is the user's own."""
    m = re.search(r"(?<=[^/])\.[^./]+$", path)
    known = {s for group in ACCEPTED.values() for s in group}
    if m is None or m[0].lower() in ACCEPTED[output] or m[0].lower() not in known:
        return path
    return path[: m.start()] + SUFFIX[output]


def save(lines: DataFrame, path: str) -> DataFrame:
    """Write ``number, line`` as a folder of text files in the order of numbers, and
    give what is there."""
    lines.sort("number").select("line").write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path).select(F.col("value").alias("line"))
