"""The registered queries of the engine's own operators, with SQL oracles.

Every query reads its whole tables and whole texts.  Searches ask for every
vector whose id is divisible by 50, against all vectors.
"""

from __future__ import annotations

import contextlib
import dataclasses
import functools
import hashlib
import http.server
import io
import json
import tempfile
import threading
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators.components import clusters
from ..operators import inverted
from ..operators.copies import copy_classes, located_pairs
from ..operators.intervals import overlapping
from ..operators.numbering import numbered
from ..operators.shape_join import links, similar_shapes
from ..operators.structure import idf, overlaps, shapes_of_arrays, similar_gated, similar_scored
from ..operators.vectors import block_rows, classes, similar_pairs, top_k
from ..sources import chat, code, embed
from ..sources.files import document_text, list_documents, list_sources
from ..sources.scratch import fresh_path, materialize
from ..sources.store import Store, listed, matches, upsert, with_status
from ..streaming.ingest import ingest_stream
from . import rag, report, settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

THETA, PAIR_THETA, MIN_DISTINCT = 0.4, 0.35, 0.003


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0")


def _path() -> F.Column:
    return F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


_SQL_PATH = "'/corpus/' || source || '/' || doc_id || '.txt'"
_SQL_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


# -- vectors ----------------------------------------------------------------


@query("""
    SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first_value,
           round(v[len(v)] / sqrt(list_dot_product(v, v)), 6) AS last_value
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings)
""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    scaled = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)))
    unit = scaled.withColumn("unit", V.normalize(F.col("v")))
    return unit.select(
        "vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.element_at("unit", 1), 6).alias("first_value"),
        F.round(F.element_at("unit", -1), 6).alias("last_value"),
    )


@query("""
    SELECT vec_id, 4 * len(embedding) AS n_bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings
""")
def vector_pack(spark: SparkSession, d: str) -> DataFrame:
    packed = _vectors(spark, d).withColumn("raw", V.pack(F.col("embedding"))).withColumn("v", V.unpack(F.col("raw")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return packed.select("vec_id", F.length("raw").cast("long").alias("n_bytes"), F.round(total, 6).alias("total"))


_KNN = """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, {score} AS score FROM e q, e c WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0)
    SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 4
"""


@query(_KNN.format(score="list_dot_product(q.v, c.v)"))
def knn_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return top_k(vectors, _asked(vectors), 4).select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_KNN.format(score="1 - list_distance(q.v, c.v) ** 2 / 2"))
def knn_distance_score(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    hits = top_k(vectors, _asked(vectors), 4, metric="distance")
    return hits.select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def knn_inverted(spark: SparkSession, d: str) -> DataFrame:
    """By an inverted file of all vectors: the bytes of the nearest cells, then whole vectors."""
    vectors = _vectors(spark, d)
    hits = inverted.build(spark, fresh_path(spark, "inverted"), vectors).search(_asked(vectors), 10)
    return hits.select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_KNN.format(score="list_dot_product(q.v, c.v)"))
def knn_inverted_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same, and then all that its bounds do not rule out."""
    vectors = _vectors(spark, d)
    hits = inverted.build(spark, fresh_path(spark, "inverted"), vectors).search(_asked(vectors), 4, exact=True)
    return hits.select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


_PAIRS = """
    e AS (SELECT min(vec_id) AS vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings GROUP BY embedding),
    pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) AS similarity
              FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= {0})
"""


@query(f"WITH {_PAIRS.format(THETA)} SELECT i, j, round(similarity, 6) AS similarity FROM pairs")
def sim_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_vectors(spark, d), THETA).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PAIRS.format(THETA)} SELECT i, j, round(similarity, 6) AS similarity FROM pairs")
def sim_pairs_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The same in small blocks, of whose pairs the bounds leave some out."""
    pairs = similar_pairs(_vectors(spark, d), THETA, block=128, cell_rows=100)
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


@query(f"""
    WITH RECURSIVE {_PAIRS.format(THETA)},
    links AS (SELECT i AS a, j AS b FROM pairs UNION ALL SELECT j, i FROM pairs UNION ALL
              SELECT a.vec_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.embedding = b.embedding AND a.vec_id <> b.vec_id),
    reach AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
    roots AS (SELECT node, min(other) AS cluster_id FROM reach GROUP BY node)
    SELECT cluster_id, node AS vec_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM roots
""")
def sim_clusters(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    pairs = similar_pairs(vectors, THETA).select(F.col("i").alias("a"), F.col("j").alias("b"))
    copies = classes(vectors).where("vec_id <> rep").select(F.col("vec_id").cast("long").alias("a"), F.col("rep").cast("long").alias("b"))
    return clusters(pairs.unionByName(copies)).select("cluster_id", F.col("node").alias("vec_id"), "cluster_size")


@query("""
    SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings
""")
def vector_classes(spark: SparkSession, d: str) -> DataFrame:
    return classes(_vectors(spark, d)).select("vec_id", "rep")


# -- structure --------------------------------------------------------------


def _page_units(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where("page_id IS NOT NULL")
    links = F.expr("regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)")
    return pages.select(
        F.col("page_id").alias("unit_id"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("path"),
        F.col("page_id").alias("start"), F.col("page_id").alias("end"), F.coalesce(F.try_element_at(links, F.lit(-1)), F.lit("")).alias("name"),
        links.alias("idents"), F.lit("page").alias("kind"), F.expr("regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)").alias("types"),
    )


def _page_shapes(spark: SparkSession, d: str) -> DataFrame:
    return shapes_of_arrays(_page_units(spark, d).select("unit_id", "types"))


_SHAPES = """
    tags AS (SELECT page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS t FROM pages),
    steps AS (SELECT page_id, t, unnest(range(1, len(t))) AS k FROM tags),
    shapes AS (SELECT page_id AS unit_id, t[k] || ' ' || t[k + 1] AS bigram, count(*) AS n FROM steps GROUP BY ALL)
"""


@query(f"WITH {_SHAPES} SELECT unit_id AS page_id, bigram, n FROM shapes")
def shape_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return _page_shapes(spark, d).select(F.col("unit_id").alias("page_id"), "bigram", "n")


_IDF = """
    total AS (SELECT count(DISTINCT unit_id) AS units FROM shapes),
    idf AS (SELECT bigram, count(*) AS df, CASE WHEN max(units) >= 25 THEN ln((max(units) + 1) / (count(*) + 0.5)) END AS weight
            FROM shapes, total GROUP BY bigram)
"""


@query(f"WITH {_SHAPES}, {_IDF} SELECT bigram, df, round(weight, 9) AS weight FROM idf")
def bigram_idf(spark: SparkSession, d: str) -> DataFrame:
    weights, _ = idf(_page_shapes(spark, d))
    return weights.select("bigram", "df", F.round("weight", 9).alias("weight"))


SHAPE_THETA = 0.6
# Both sides' bigrams are multiplied out over all pairs of representatives.
_ALIKE = f"""
    {_SHAPES}, {_IDF},
    signed AS (SELECT unit_id, string_agg(bigram || ' ' || n, ';' ORDER BY bigram) AS sign FROM shapes GROUP BY unit_id),
    members AS (SELECT unit_id, min(unit_id) OVER (PARTITION BY sign) AS rep FROM signed),
    own AS (SELECT s.unit_id, s.bigram, s.n, coalesce(w.weight, 1) AS weight FROM shapes s JOIN idf w USING (bigram) WHERE s.unit_id IN (SELECT rep FROM members)),
    totals AS (SELECT unit_id, sum(n * weight) AS total FROM own GROUP BY unit_id),
    met AS (SELECT x.unit_id AS i, y.unit_id AS j, sum(least(x.n, y.n) * x.weight) AS shared FROM own x JOIN own y ON x.bigram = y.bigram AND x.unit_id < y.unit_id GROUP BY ALL),
    alike AS (SELECT i, j, shared / (a.total + b.total - shared) AS structural FROM met JOIN totals a ON a.unit_id = i JOIN totals b ON b.unit_id = j
              WHERE shared / (a.total + b.total - shared) >= {SHAPE_THETA})
"""


@query(f"WITH {_ALIKE} SELECT i, j, round(structural, 6) AS structural FROM alike")
def structure_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Classes of pages of one shape whose shapes are similar, without vectors."""
    pairs, _ = similar_shapes(_page_shapes(spark, d), SHAPE_THETA)
    return pairs.select("i", "j", F.round("structural", 6).alias("structural"))


@query(f"""
    WITH {_ALIKE}, sizes AS (SELECT rep, count(*) AS members FROM members GROUP BY rep),
    ends AS (SELECT i AS own, j AS other FROM alike UNION ALL SELECT j, i FROM alike),
    others AS (SELECT own, sum(members) AS others FROM ends JOIN sizes ON rep = other GROUP BY own)
    SELECT unit_id AS page_id, rep, (members - 1 + coalesce(others, 0))::BIGINT AS links FROM members JOIN sizes USING (rep) LEFT JOIN others ON own = rep
""")
def structure_join(spark: SparkSession, d: str) -> DataFrame:
    """Every shaped page, its class, and how many pages have a similar shape."""
    return links(*similar_shapes(_page_shapes(spark, d), SHAPE_THETA)).select(F.col("unit_id").alias("page_id"), "rep", "links")


# Both sides of the union are written out here, unlike in the operator.
_SCORED = f"""
    {_PAIRS.format(PAIR_THETA)}, {_SHAPES}, {_IDF},
    keys AS (SELECT i, j, similarity FROM pairs),
    grams AS (SELECT k.i, k.j, s.bigram FROM keys k JOIN shapes s ON s.unit_id = k.i
              UNION SELECT k.i, k.j, s.bigram FROM keys k JOIN shapes s ON s.unit_id = k.j),
    counts AS (SELECT g.i, g.j, g.bigram, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, w.weight
               FROM grams g LEFT JOIN shapes a ON a.unit_id = g.i AND a.bigram = g.bigram
               LEFT JOIN shapes b ON b.unit_id = g.j AND b.bigram = g.bigram JOIN idf w ON w.bigram = g.bigram),
    sums AS (SELECT i, j, sum(least(na, nb)) AS inter, sum(greatest(na, nb)) AS either, sum(least(na, nb) * weight) AS winter,
                    sum(greatest(na, nb) * weight) AS weither, sum(na) AS ta, sum(nb) AS tb FROM counts GROUP BY i, j),
    scored AS (SELECT k.i, k.j, k.similarity,
                 CASE WHEN ta > 0 AND tb > 0 THEN inter / either END AS plain,
                 CASE WHEN ta > 0 AND tb > 0 THEN winter / weither END AS weighted,
                 CASE WHEN ta > 0 AND tb > 0 THEN CASE WHEN inter > 0 THEN winter / inter / ln((units + 1) / 0.5) ELSE 0 END END AS distinctness
               FROM keys k LEFT JOIN sums USING (i, j), total)
"""


@query(f"""
    WITH {_SCORED} SELECT i, j, round(plain, 6) AS structural_plain, round(weighted, 6) AS structural_idf,
                          round(distinctness, 6) AS distinctiveness FROM scored
""")
def structural_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = similar_scored(_vectors(spark, d), PAIR_THETA, _page_shapes(spark, d))
    return scored.select(
        "i", "j", F.round("structural_plain", 6).alias("structural_plain"), F.round("structural", 6).alias("structural_idf"),
        F.round("distinct", 6).alias("distinctiveness"),
    )


_GATED = f"""
    {_SCORED},
    units AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
                     regexp_extract_all(html, 'href="/([^"]*)"', 1) AS idents FROM pages),
    gated AS (SELECT s.* FROM scored s JOIN units a ON a.page_id = s.i JOIN units b ON b.page_id = s.j
              WHERE NOT (a.host = b.host AND a.page_id <= b.page_id AND b.page_id <= a.page_id)
                AND NOT (len(a.idents) > 0 AND a.idents[-1] <> '' AND list_contains(b.idents, a.idents[-1]))
                AND NOT (len(b.idents) > 0 AND b.idents[-1] <> '' AND list_contains(a.idents, b.idents[-1]))
                AND (weighted IS NULL OR weighted >= 0.5) AND (distinctness IS NULL OR distinctness >= {MIN_DISTINCT}))
"""


def _gated(spark: SparkSession, d: str, units: DataFrame | None = None) -> DataFrame:
    units = units or _written_units(spark, d)
    return similar_gated(_vectors(spark, d), PAIR_THETA, units, shapes_of_arrays(units.select("unit_id", "types")), 0.5, MIN_DISTINCT)


def _written_units(spark: SparkSession, d: str) -> DataFrame:
    """Written once, as finding tags and links in a page takes longer than reading them."""
    return materialize(_page_units(spark, d), "page-units")


@query(f"WITH {_GATED} SELECT i, j, round(similarity, 6) AS similarity, round(weighted, 6) AS structural FROM gated")
def gated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("i", "j", F.round("similarity", 6).alias("similarity"), F.round("structural", 6).alias("structural"))


_REF = "{0}.host || ':' || {0}.page_id || '-' || {0}.page_id || CASE WHEN len({0}.idents) > 0 AND {0}.idents[-1] <> '' THEN ' ' || {0}.idents[-1] ELSE '' END"
_TEXT_LINE = f"""
    printf('%.3f', similarity) || '  struct ' || coalesce(printf('%.3f', weighted), 'n/a') || '  distinct ' ||
    coalesce(printf('%.3f', distinctness), 'n/a') || '  ' || {_REF.format("a")} || '  <->  ' || {_REF.format("b")}
"""
_MARKDOWN_LINE = f"""
    '| ' || printf('%.3f', similarity) || ' | ' || coalesce(printf('%.3f', weighted), 'n/a') || ' | ' ||
    coalesce(printf('%.3f', distinctness), 'n/a') || ' | `' || {_REF.format("a")} || '` | `' || {_REF.format("b")} || '` |'
"""
_REPORT = "WITH {0} SELECT g.i, g.j, {1} AS line FROM gated g JOIN units a ON a.page_id = g.i JOIN units b ON b.page_id = g.j"


def _report(spark: SparkSession, d: str) -> DataFrame:
    units = _written_units(spark, d)
    return report.with_refs(_gated(spark, d, units), units)


@query(_REPORT.format(_GATED, _TEXT_LINE))
def report_text(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("i", "j", report.pair_line("text").alias("line"))


@query(_REPORT.format(_GATED, _MARKDOWN_LINE))
def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("i", "j", report.pair_line("markdown").alias("line"))


@query(f"""
    WITH {_GATED} SELECT i, j, round_even(similarity, 4) AS similarity, round_even(weighted, 4) AS structural,
                         round_even(distinctness, 4) AS distinctiveness, i AS a_start, j AS b_start FROM gated
""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    shape = (
        "similarity double, structural double, distinctiveness double, "
        "a struct<path string, start long, end long, name string, kind string>, b struct<path string, start long, end long, name string, kind string>"
    )
    rows = _report(spark, d).select("i", "j", F.from_json(report.pair_json(), shape).alias("p"))
    return rows.select("i", "j", "p.similarity", "p.structural", "p.distinctiveness", F.col("p.a.start").alias("a_start"), F.col("p.b.start").alias("b_start"))


_CLUSTERS = f"""
    {_GATED}, links AS (SELECT i AS a, j AS b FROM gated UNION ALL SELECT j, i FROM gated),
    reach AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
    roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
    members AS (SELECT node, root, count(*) OVER (PARTITION BY root) AS cluster_size FROM roots)
"""


@query(f"""
    WITH RECURSIVE {_CLUSTERS}
    SELECT dense_rank() OVER (ORDER BY cluster_size DESC, root) AS number, cluster_size, node, '- `' || {_REF.format("a")} || '`' AS line
    FROM members JOIN units a ON a.page_id = node
""")
def report_clusters(spark: SparkSession, d: str) -> DataFrame:
    units = _written_units(spark, d)
    pairs = _gated(spark, d, units).select(F.col("i").alias("a"), F.col("j").alias("b"))
    return report.cluster_lines(clusters(pairs), units, "markdown")


@query(f"""
    WITH RECURSIVE {_CLUSTERS}
    SELECT (SELECT count(*) FROM pages) AS units, (SELECT count(*) FROM gated) AS pairs, (SELECT count(DISTINCT root) FROM members) AS clusters
""")
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    units = _written_units(spark, d)
    pairs = materialize(_gated(spark, d, units).select(F.col("i").alias("a"), F.col("j").alias("b")), "pairs")
    one = units.agg(F.count("*").alias("units")).join(pairs.agg(F.count("*").alias("pairs")))
    return one.join(clusters(pairs).agg(F.countDistinct("cluster_id").alias("clusters")))


@query(f"WITH {_GATED} SELECT i, j, round(similarity, 6) AS similarity FROM gated ORDER BY gated.similarity DESC, i, j LIMIT 5")
def report_top(spark: SparkSession, d: str) -> DataFrame:
    """The report's best pairs, where its limit is the feature."""
    return report.ranked(_gated(spark, d), 5).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query(f"""
    WITH {_GATED}, ranked AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, i, j) AS number FROM gated)
    SELECT {_TEXT_LINE} AS line FROM ranked JOIN units a ON a.page_id = i JOIN units b ON b.page_id = j
""")
def report_sink(spark: SparkSession, d: str) -> DataFrame:
    units = _written_units(spark, d)
    # Written before they are ranged, which reads them twice.
    pairs = materialize(_gated(spark, d, units), "pairs")
    rows = numbered(report.with_refs(pairs, units), "number", F.desc("similarity"), "i", "j")
    return report.save(rows.select("number", report.pair_line("text").alias("line")), fresh_path(spark, "report"))


_PATHS = tuple((p, o) for p in ("r", "r.txt", "a.b/r.MD", "r.json", "r.markdown", "r.csv", "x.d/r.text") for o in report.SUFFIX)
_SUFFIX_SQL = "CASE output WHEN 'text' THEN '.txt' WHEN 'json' THEN '.json' ELSE '.md' END"


@query("""
    WITH v(path, output) AS (VALUES """ + ", ".join(f"('{p}', '{o}')" for p, o in _PATHS) + f"""),
    s AS (SELECT *, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix FROM v)
    SELECT path, output, CASE WHEN suffix NOT IN ('.txt', '.text', '.json', '.md', '.markdown') OR suffix = {_SUFFIX_SQL}
      OR (output = 'text' AND suffix = '.text') OR (output = 'markdown' AND suffix = '.markdown') THEN path
      ELSE left(path, length(path) - length(suffix)) || {_SUFFIX_SQL} END AS fixed FROM s
""")
def report_paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p, o, report.report_path(p, o)) for p, o in _PATHS], "path string, output string, fixed string")


@query(r"""
    WITH w AS (SELECT doc_id, unnest(range(0, CASE WHEN n <= 8 THEN 1 ELSE (n - 8 + 5) // 6 + 1 END)) AS k, n, source
               FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, source FROM documents WHERE text IS NOT NULL)),
    u AS (SELECT source AS path, doc_id * 100000 + k AS unit_id, doc_id * 40 + k * 6 + 1 AS a, doc_id * 40 + least(k * 6 + 8, n) AS b FROM w)
    SELECT x.unit_id AS i, y.unit_id AS j FROM u x JOIN u y ON x.path = y.path AND x.unit_id < y.unit_id AND y.a - x.a < 45
    WHERE NOT (x.a <= y.b AND y.a <= x.b)
""")
def overlap_gate(spark: SparkSession, d: str) -> DataFrame:
    """Line windows, some of which overlap, as pairs that come within 45 lines."""
    n = F.size(F.split("text", "\n", -1))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "source", n.alias("n"))
    count = F.when(F.col("n") <= 8, 1).otherwise(F.ceil((F.col("n") - 8) / F.lit(6)) + 1).cast("int")
    k = docs.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    base = F.col("doc_id") * 40
    units = k.select(F.col("source").alias("path"), (F.col("doc_id") * 100_000 + F.col("k")).alias("unit_id"), (base + F.col("k") * 6 + 1).alias("start"), (base + F.least(F.col("k") * 6 + 8, "n")).alias("end"))
    one = F.struct("unit_id", "path", "start", "end")
    # Neighbours by blocks of lines, so that pairs grow with the rows.
    a = units.select("path", F.floor(F.col("start") / 45).alias("block"), one.alias("a"))
    b = units.select("path", F.explode(F.array(F.floor(F.col("start") / 45), F.floor(F.col("start") / 45) - 1)).alias("block"), one.alias("b"))
    near = a.join(b, ["path", "block"]).where("a.unit_id < b.unit_id AND b.start - a.start < 45")
    lower = units.select("path", F.floor(F.col("start") / 45).alias("block"), one.alias("b"))
    upper = units.select("path", (F.floor(F.col("start") / 45) - 1).alias("block"), one.alias("a"))
    back = upper.join(lower, ["path", "block"]).where("a.unit_id < b.unit_id AND b.start - a.start < 45")
    both = near.select("a", "b").unionAll(back.select("a", "b"))
    return both.where(~overlaps("a", "b")).select(F.col("a.unit_id").alias("i"), F.col("b.unit_id").alias("j"))


@query("""
    WITH u AS (SELECT source AS path, doc_id AS id, doc_id AS a, doc_id + len(string_split(text, chr(10))) - 1 AS b FROM documents WHERE text IS NOT NULL)
    SELECT x.id AS i, y.id AS j FROM u x JOIN u y ON x.path = y.path AND x.id < y.id AND x.a <= y.b AND y.a <= x.b
""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents laid out by id, a line each, in their source: which of them share lines."""
    n = F.size(F.split("text", "\n", -1))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("source", F.col("doc_id").alias("id"), F.col("doc_id").alias("start"), (F.col("doc_id") + n - 1).alias("end"))
    return overlapping(docs, ["source"]).select("i", "j")


@query("""
    WITH lines AS (SELECT doc_id, unnest(range(1, len(l))) AS k, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    units AS (SELECT doc_id * 100000 + k AS unit_id, doc_id, k AS a, k + 1 AS b, l[k] || chr(10) || l[k + 1] AS t FROM lines),
    linked AS (SELECT x.unit_id, x.t FROM units x WHERE EXISTS (SELECT 1 FROM units y WHERE y.t = x.t AND NOT (x.doc_id = y.doc_id AND x.a <= y.b AND y.a <= x.b)))
    SELECT unit_id, min(unit_id) OVER (PARTITION BY t) AS cluster_id, count(*) OVER (PARTITION BY t) AS cluster_size FROM linked
""")
def copy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Two lines in a row that stand elsewhere too, without those that they overlap."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("l"))
    k = docs.where(F.size("l") > 1).select("doc_id", "l", F.explode(F.sequence(F.lit(1), F.size("l") - 1)).alias("start"))
    both = F.concat(F.element_at("l", F.col("start")), F.lit("\n"), F.element_at("l", F.col("start") + 1))
    units = k.select((F.col("doc_id") * 100_000 + F.col("start")).alias("unit_id"), F.format_string("%020d", "doc_id").alias("path"), "start", (F.col("start") + 1).alias("end"), both.alias("t"))
    classes, members = copy_classes(units, "t")
    own = classes.where("members > 1").select(F.col("cls").alias("i"), F.col("cls").alias("j"))
    pairs = located_pairs(own, classes, members)
    return clusters(pairs.select(F.col("i").alias("a"), F.col("j").alias("b"))).select(F.col("node").alias("unit_id"), "cluster_id", "cluster_size")


# -- texts ------------------------------------------------------------------

# Documents have no blank lines: doubled newlines make paragraphs of lines.
_PARAGRAPHS = "replace(text, chr(10), chr(10) || chr(10))"


@query(f"""
    SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM (
      SELECT doc_id, regexp_replace({_SQL_STRIP.format("'  ' || replace(text, chr(10), chr(10) || chr(10) || chr(10)) || chr(10)")}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t
      FROM documents)
""")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    wide = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n")), F.lit("\n"))
    t = T.normalize(wide)
    return table(spark, d, "documents").select("doc_id", F.md5(t.cast("binary")).alias("text_md5"), F.length(t).cast("long").alias("n"))


@query(f"""
    WITH s AS (SELECT doc_id, {_SQL_STRIP.format("text")} AS t FROM documents),
    k AS (SELECT doc_id, t, CASE WHEN length(t) > 1200 THEN (length(t) - 1200 + 999) // 1000 ELSE 0 END AS cuts FROM s WHERE t <> '')
    SELECT doc_id, o AS ord, CASE WHEN o < cuts THEN 1200 ELSE length(t) - 1000 * cuts END AS n,
           md5(CASE WHEN o < cuts THEN substr(t, o * 1000 + 1, 1200) ELSE substr(t, cuts * 1000 + 1) END) AS chunk_md5
    FROM (SELECT *, unnest(range(0, cuts + 1)) AS o FROM k)
""")
def chunk_hard_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.chunk(F.col("text"))).alias("ord", "c"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("chunk_md5"))


# The fold over a document's paragraphs, one a round.
@query(f"""
    WITH RECURSIVE p AS (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_SQL_STRIP.format(_PARAGRAPHS)}, '\\n{{3,}}', chr(10) || chr(10), 'g'),
             chr(10) || chr(10)), lambda x: {_SQL_STRIP.format("x")}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
    fold AS (
      SELECT doc_id, 0 AS k, []::VARCHAR[] AS done, '' AS held FROM p WHERE len(p) > 0
      UNION ALL
      SELECT doc_id, k + 1, list_concat(done_before, CASE WHEN start_text <> '' AND NOT fits THEN [start_text] ELSE []::VARCHAR[] END),
             CASE WHEN start_text = '' THEN rest WHEN fits THEN start_text || chr(10) || chr(10) || rest
                  ELSE {_SQL_STRIP.format("right(start_text, 200) || chr(10) || chr(10) || rest")} END
      FROM (SELECT *, length(start_text) + length(rest) + 2 <= 1200 AS fits FROM (
        SELECT doc_id, k, list_concat(done, CASE WHEN cuts > 0 AND held <> '' THEN [held] ELSE []::VARCHAR[] END,
                 list_transform(range(0, cuts), lambda i: substr(para, i * 1000 + 1, 1200))) AS done_before,
               CASE WHEN cuts > 0 THEN '' ELSE held END AS start_text, CASE WHEN cuts > 0 THEN substr(para, cuts * 1000 + 1) ELSE para END AS rest
        FROM (SELECT f.*, p.p[k + 1] AS para, CASE WHEN length(p.p[k + 1]) > 1200 THEN (length(p.p[k + 1]) - 1200 + 999) // 1000 ELSE 0 END AS cuts
              FROM fold f JOIN p USING (doc_id) WHERE k < len(p.p))))),
    last AS (SELECT doc_id, unnest(list_concat(done, [held])) AS c, unnest(range(0, len(done) + 1)) AS ord FROM fold JOIN p USING (doc_id) WHERE k = len(p))
    SELECT doc_id, ord, length(c) AS n, md5(c) AS chunk_md5 FROM last
""")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        "doc_id", F.posexplode(T.chunk(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))).alias("ord", "c")
    )
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("chunk_md5"))


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, l, len(l) AS n, CASE WHEN len(l) <= 8 THEN 1 ELSE (len(l) - 8 + 5) // 6 + 1 END AS k FROM l),
    w AS (SELECT doc_id, l, n, unnest(range(0, k)) AS i FROM c),
    b AS (SELECT doc_id, i * 6 + 1 AS start_line, least(i * 6 + 8, n) AS end_line, array_to_string(l[i * 6 + 1 : least(i * 6 + 8, n)], chr(10)) AS block FROM w)
    SELECT doc_id, start_line, end_line, md5(block) AS block_md5 FROM b
    WHERE end_line - start_line + 1 >= 2 AND regexp_matches(block, '\\S')
""")
def line_windows(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.explode(T.windows(T.lines(F.col("text")), 8, 2, 2)).alias("w"))
    return found.select(
        "doc_id", F.col("w.start").cast("long").alias("start_line"), F.col("w.end").cast("long").alias("end_line"),
        F.md5(F.col("w.block").cast("binary")).alias("block_md5"),
    )


@query(r"""
    WITH l AS (SELECT doc_id, list_transform(string_split('    ' || replace(text, chr(10), chr(10) || '      ') || chr(10), chr(10)),
                 lambda x: CASE WHEN regexp_matches(x, '^[ \t]+$') THEN '' ELSE x END) AS l FROM documents),
    m AS (SELECT doc_id, l, coalesce(list_min(list_transform(list_filter(l, lambda x: x <> ''), lambda x: length(regexp_extract(x, '^[ \t]*')))), 0) AS m FROM l)
    SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(l, lambda x: substr(x, m + 1)), chr(10)), '^\n+|\n+$', '', 'g')) AS unit_md5 FROM m
""".replace("\\\\", "\\"))
def dedent_units(spark: SparkSession, d: str) -> DataFrame:
    indented = F.concat(F.lit("    "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n      ")), F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.unit_text(indented).cast("binary")).alias("unit_md5"))


_WINDOW_UNITS = """
    WITH l AS (SELECT {path} AS path, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
    c AS (SELECT *, len(l) AS n, CASE WHEN len(l) <= 8 THEN 1 ELSE (len(l) - 8 + 5) // 6 + 1 END AS k FROM l),
    w AS (SELECT path, l, n, unnest(range(0, k)) AS i FROM c),
    b AS (SELECT path, i * 6 + 1 AS first, least(i * 6 + 8, n) AS last, array_to_string(l[i * 6 + 1 : least(i * 6 + 8, n)], chr(10)) AS block FROM w),
    u AS (SELECT path, first, last, block FROM b WHERE last - first + 1 >= 2 AND regexp_matches(block, '\\S'))
"""


@query(f"""
    {_WINDOW_UNITS.format(path=_SQL_PATH)}
    SELECT path, 'window' AS kind, first AS "start", last AS "end", md5(regexp_replace(block, '^\\n+|\\n+$', '', 'g')) AS unit_md5 FROM u
""")
def extract_windows(spark: SparkSession, d: str) -> DataFrame:
    """Files without a parser give line windows."""
    files = table(spark, d, "documents").select(_path().alias("path"), F.col("text").cast("binary").alias("content"))
    found = code.extract(files.where("path IS NOT NULL AND content IS NOT NULL"), 2, 8, 2)
    return found.select("path", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.col("text").cast("binary")).alias("unit_md5"))


# A Python file of each document: a function, a class with a method, and a short one.
_SOURCE = (
    "import os", "", "def run_{id}(first, second):", "    {lang} = first", "    total = {lang} + second", "    return total", "",
    "class Kind_{id}:", "    def act(self, value_{id}):", "        for {lang} in value_{id}:", "            print({lang})", "        return self", "",
    "def short(x):", "    return x", "",
)


def _source_text() -> F.Column:
    parts = "\n".join(_SOURCE).replace("{id}", "\0id\0").replace("{lang}", "\0lang\0").split("\0")
    return F.concat(*(F.col("doc_id").cast("string") if p == "id" else F.col("lang") if p == "lang" else F.lit(p) for p in parts))


def _source_sql(lines: tuple[str, ...], cut: int = 0) -> str:
    text = "\n".join(x[cut:] for x in lines)
    text = text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{id}", "' || doc_id || '").replace("{lang}", "' || lang || '")
    return f"'{text}'"


@query(f"""
    WITH s AS (SELECT '/src/' || source || '/' || doc_id || '.py' AS path, doc_id, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
    SELECT path, 'function' AS kind, 'run_' || doc_id AS name, 3 AS "start", 6 AS "end", md5({_source_sql(_SOURCE[2:6])}) AS unit_md5,
           array_to_string(list_sort(['run_' || doc_id, 'first', 'second', lang, 'total']), ' ') AS idents FROM s
    UNION ALL
    SELECT path, 'class', 'Kind_' || doc_id, 8, 12, md5({_source_sql(_SOURCE[7:12])}),
           array_to_string(list_sort(['Kind_' || doc_id, 'act', 'self', 'value_' || doc_id, lang, 'print']), ' ') FROM s
    UNION ALL
    SELECT path, 'function', 'act', 9, 12, md5({_source_sql(_SOURCE[8:12], 4)}),
           array_to_string(list_sort(['act', 'self', 'value_' || doc_id, lang, 'print']), ' ') FROM s
""")
def extract_units(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of parsed files, with names, lines, texts and identifiers."""
    docs = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    path = F.concat(F.lit("/src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    found = code.extract(docs.select(path.alias("path"), _source_text().cast("binary").alias("content")), 4)
    return found.select(
        "path", "kind", "name", "start", "end", F.md5(F.col("text").cast("binary")).alias("unit_md5"), F.array_join(F.array_sort("idents"), " ").alias("idents")
    )


@query(f"""
    {_WINDOW_UNITS.format(path=_SQL_PATH)}
    SELECT row_number() OVER (ORDER BY path, first, last) - 1 AS unit_id, path, first AS "start", last AS "end" FROM u
""")
def unit_order(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").where("source IS NOT NULL").select(_path().alias("path"), F.explode(T.windows(T.lines(F.col("text")), 8, 2, 2)).alias("w"))
    units = found.select("path", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))
    return numbered(units, "unit_id", "path", "start", "end")


@query("""
    SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS lines_md5
    FROM (SELECT doc_id, list_transform(string_split(replace(text, chr(10), chr(13) || chr(13) || chr(10)) || chr(10), chr(10)), lambda x: rtrim(x, chr(13))) AS l FROM documents)
""")
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    wide = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\r\n")), F.lit("\n"))
    rows = table(spark, d, "documents").select("doc_id", T.lines(wide).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|").cast("binary")).alias("lines_md5"))


_TYPES = (
    "function_definition", "method_declaration", "class_specifier", "struct_item", "field_declaration", "access_specifier",
    "arrow_function", "function_expression", "class", "def", "singleton_method", "type_spec", "impl_item", "if_statement", "enum_specifier",
)
_VALUES = ", ".join(f"('{t}')" for t in _TYPES)


@query(f"""
    SELECT t AS node_type, d AS is_definition, CASE WHEN NOT d THEN NULL WHEN regexp_matches(t, '^(function|method|constructor|subroutine|procedure)')
      OR t IN ('arrow_function', 'function_expression', 'method', 'function', 'def', 'singleton_method') THEN 'function' ELSE 'class' END AS kind
    FROM (SELECT t, t IN ('method', 'class', 'module', 'singleton_method', 'function', 'def', 'arrow_function', 'function_expression') OR
      (regexp_matches(t, '(_definition|_declaration|_item|_specifier)$') AND regexp_matches(t, '^(function|method|class|struct|interface|constructor|impl|trait|module|enum|union|namespace|record|protocol|object|type|subroutine|procedure|singleton)')) AS d
      FROM (VALUES {_VALUES}) v(t))
""")
def definition_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("node_type")
    rows = spark.createDataFrame([(x,) for x in _TYPES], "node_type string")
    return rows.select(t, code.is_definition(t).alias("is_definition"), F.when(code.is_definition(t), code.kind_of(t)).alias("kind"))


# -- store and cache --------------------------------------------------------


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL")
    return docs.select(_path().alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"), "doc_id", "lang")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """What an older run left: French documents are missing, German ones differ."""
    old = _incoming(spark, d).where("lang <> 'fr'")
    return old.withColumn("sha256", F.when(F.col("lang") == "de", F.lit("0" * 64)).otherwise(F.col("sha256"))).select("path", "sha256")


_STORE = f"""
    new AS (SELECT {_SQL_PATH} AS path, sha256(coalesce(text, '')) AS sha256, doc_id, lang FROM documents WHERE source IS NOT NULL),
    old AS (SELECT path, CASE WHEN lang = 'de' THEN repeat('0', 64) ELSE sha256 END AS sha256 FROM new WHERE lang <> 'fr')
"""


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


@query(f"""
    WITH {_STORE} SELECT n.path, n.sha256, CASE WHEN o.path IS NULL THEN 'new' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'changed' END AS status
    FROM new n LEFT JOIN old o USING (path)
""")
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    return with_status(_incoming(spark, d), _stored(spark, d)).select("path", "sha256", "status")


@query(f"""
    WITH {_STORE}, part AS (SELECT path, sha256 FROM new WHERE lang IN ('fr', 'de'))
    SELECT path, sha256 FROM old WHERE path NOT IN (SELECT path FROM part) UNION ALL SELECT path, sha256 FROM part
""")
def upsert_docs(spark: SparkSession, d: str) -> DataFrame:
    fresh = _incoming(spark, d).where("lang IN ('fr', 'de')").select("path", "sha256")
    return upsert(_stored(spark, d), fresh)


@query(f"WITH {_STORE} SELECT path FROM new WHERE NOT (path ILIKE '%SRC1_/%')")
def forget_like(spark: SparkSession, d: str) -> DataFrame:
    rows = _incoming(spark, d)
    return rows.where(~matches(F.col("path"), "SRC1_/")).select("path")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_name ILIKE '%a_e%')")
def forget_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    return rows.where(~matches(F.col("p_name"), "a_e")).select("p_partkey", "p_name")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", "text", "lang", embed.text_hash().alias("hash"))


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache that knows the English texts for one model."""
    return _texts(spark, d).where("lang = 'en'").select("hash").distinct().select("hash", F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("vector"))


_CACHE = "texts AS (SELECT doc_id, lang, sha256(text) AS hash FROM documents WHERE text IS NOT NULL), cache AS (SELECT DISTINCT hash FROM texts WHERE lang = 'en')"


@query(f"WITH {_CACHE} SELECT doc_id, t.hash FROM texts t JOIN cache c ON t.hash = c.hash")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return embed.cache_hits(_texts(spark, d), _cache(spark, d), "m").select("doc_id", "hash")


@query(f"WITH {_CACHE} SELECT DISTINCT hash FROM texts WHERE hash NOT IN (SELECT hash FROM cache)")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return embed.cache_misses(_texts(spark, d), _cache(spark, d), "m").select("hash")


@query("""
    WITH rows AS (SELECT sha256(text) AS hash, lang AS model, doc_id AS seq FROM documents WHERE text IS NOT NULL)
    SELECT hash, model, max(seq) AS seq FROM rows GROUP BY hash, model
""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).select("hash", F.col("lang").alias("model"), F.col("doc_id").alias("seq"))
    return embed.cache_upsert(rows.where("model = 'en'"), rows.where("model <> 'en'")).select("hash", "model", "seq")


@query("""
    WITH t AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, hash, (SELECT count(*) FROM t) AS n_rows FROM t
""")
def embed_reexpand(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    empty = spark.createDataFrame([], "hash string, model string, vector array<float>")
    rows, _ = embed.embed_all(texts, empty, embed.HashEmbedder())
    total = texts.agg(F.count("*").alias("n_rows"))
    return rows.where("size(vector) = 64").select("doc_id", "hash").join(F.broadcast(total), F.lit(True))


@query("""
    WITH s AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE source IS NOT NULL)
    SELECT '/corpus/' || source || '/' || doc_id || '.txt' AS path, sha256(d.text) AS sha256,
           CASE WHEN length(t) > 1200 THEN (length(t) - 1200 + 999) // 1000 + 1 ELSE 1 END AS chunks
    FROM s JOIN documents d USING (doc_id, source) WHERE t <> ''
""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "documents").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if is_folder else "documents.parquet")
    files = files.parquet(f"{d}/documents.parquet" if is_folder else d)
    stream = files.where("doc_id IS NOT NULL AND source IS NOT NULL").select(_path().alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "text")
    store = Store(spark, fresh_path(spark, "store"))
    # The second run finds nothing new, and would change nothing if it did.
    for _ in range(2):
        ingest_stream(stream, store, store.root + "-progress").awaitTermination()
    return store.documents().select("path", "sha256", F.col("chunks").cast("long").alias("chunks"))


# First everything but German, then all of it: French ones without a text by then, and
# Spanish ones changed.
_STRIPPED = _SQL_STRIP.format("coalesce(text, '')")
_INGESTED = f"""
    s AS (SELECT {_SQL_PATH} AS path, lang, {_STRIPPED} AS t, text FROM documents WHERE source IS NOT NULL),
    n AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN length(t) > 1200 THEN (length(t) - 1200 + 999) // 1000 + 1 ELSE 1 END AS n FROM s)
"""


def _ingested(spark: SparkSession, d: str) -> tuple[Store, DataFrame]:
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    store = Store(spark, fresh_path(spark, "store"))
    rows = docs.select(_path().alias("path"), F.sha2(text.cast("binary"), 256).alias("sha256"), "text", "lang")
    store.ingest(rows.where("lang <> 'de'").drop("lang"))
    gone = F.col("lang") == "fr"
    changed = F.col("lang").isin("fr", "es")
    later = rows.select(
        "path", F.when(changed, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(~gone, F.col("text")).alias("text"), F.when(gone & F.col("text").like("%a%"), "unreadable").alias("error"),
    )
    return store, store.ingest(later)


@query(f"""
    WITH {_INGESTED}
    SELECT path, CASE WHEN lang = 'fr' AND text LIKE '%a%' THEN 'error' WHEN lang = 'fr' THEN 'empty' WHEN lang = 'en' AND n > 0 THEN 'unchanged'
                      WHEN n = 0 THEN 'empty' WHEN lang = 'de' THEN 'new' WHEN lang = 'es' THEN 'changed' ELSE 'unchanged' END AS status,
           CASE WHEN lang IN ('de', 'es') THEN n ELSE 0 END AS chunks, CASE WHEN lang = 'fr' AND text LIKE '%a%' THEN 'unreadable' END AS message FROM n
""")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d)[1].select("path", "status", F.col("chunks").cast("long").alias("chunks"), "message")


@query(f"""
    WITH {_INGESTED}, kept AS (SELECT * FROM n WHERE NOT path ILIKE '%SRC1_/%')
    SELECT path, unnest(range(0, n)) AS ord FROM kept
""")
def forget_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that stay when documents are forgotten."""
    store, _ = _ingested(spark, d)
    store.forget("SRC1_/")
    return store.chunks().select("path", F.col("ord").cast("long").alias("ord"))


@query(f"""
    WITH {_INGESTED},
    one AS (SELECT path, sha256(coalesce(text, '')) AS sha256, n AS chunks FROM n WHERE lang <> 'de' AND n > 0),
    two AS (SELECT path, CASE WHEN lang = 'es' THEN sha256(sha256(coalesce(text, ''))) ELSE sha256(coalesce(text, '')) END AS sha256, n AS chunks FROM n WHERE n > 0),
    three AS (SELECT * FROM two WHERE NOT path ILIKE '%SRC1_/%')
    SELECT 1 AS version, * FROM one UNION ALL SELECT 2, * FROM two UNION ALL SELECT 3, * FROM three UNION ALL SELECT 4, * FROM three
""")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each version of a store: two batches, a removal and a merge."""
    store, _ = _ingested(spark, d)
    store.forget("SRC1_/")
    store.compact(whole=True)
    held = [store.documents(version=v).select(F.lit(v).alias("version"), "path", "sha256", F.col("chunks").cast("long").alias("chunks")) for v in store.versions()]
    return functools.reduce(DataFrame.unionByName, held)


@query(f"""
    SELECT path, printf('%5d chunks  %s  %s', chunks, strftime(TIMESTAMP '2024-03-01 10:05:59' + to_minutes(CAST(doc_id AS INTEGER)), '%Y-%m-%d %H:%M'), path) AS line
    FROM (SELECT {_SQL_PATH} AS path, doc_id, length(text) % 7 AS chunks FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)
""")
def docs_listing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 10:05:59")) + 60 * F.col("doc_id"))
    return listed(docs.select(_path().alias("path"), (F.length("text") % 7).alias("chunks"), at.alias("added_at"))).select("path", "line")


@query(f"WITH {_CACHE} SELECT DISTINCT hash, 64 AS dim FROM texts")
def cache_resume(spark: SparkSession, d: str) -> DataFrame:
    """The cache filled with some texts, then with all, in commits of 100."""
    cache, texts = embed.VectorCache(spark, fresh_path(spark, "cache"), 100), _texts(spark, d)
    cache.fill(texts.where("lang = 'en'"), embed.HashEmbedder())
    return cache.fill(texts, embed.HashEmbedder()).select("hash", F.size("vector").alias("dim"))


def _docx(*lines: str) -> bytes:
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(out, "w") as z:
        # A fixed time: by the clock's the archive's hash would differ from process to process.
        z.writestr(zipfile.ZipInfo("word/document.xml", (1980, 1, 1, 0, 0, 0)), f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


# Files of many kinds, and what is read from them; none is left out.
_FILES: tuple[tuple[str, bytes, str | None], ...] = (
    ("a.TXT", b"one\r\ntwo\rthree", "one|two|three"), ("sub/b.md", "é # b".encode(), "é # b"), ("sub/c.py", b"x = '\xff'", "x = '\ufffd'"),
    ("sub/vendor/d.py", b"d", "d"), ("e.docx", _docx("p", "q"), "p|q"), ("f.docx", b"no archive", None), (".hidden.md", b"h", ""), ("g.bin", b"g", ""),
    ("sub/.dir/h.py", b"h = 1", ""), ("i", b"no suffix", ""), ("named.odd", b"named", "named"),
)


def _files(spark: SparkSession) -> str:
    root = fresh_path(spark, "files")
    jvm = spark._jvm.org.apache.hadoop.fs
    for name, content, _ in _FILES:
        path = jvm.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content))
        out.close()
    return root


@query("""
    SELECT name, sha256, CASE WHEN ok THEN said END AS said, NOT ok AS failed
    FROM (VALUES """ + ", ".join(
        f"('{n}', '{hashlib.sha256(c).hexdigest()}', '{(t or '').replace(chr(39), chr(39) * 2)}', {str(t is not None).lower()})" for n, c, t in _FILES if t != ""
    ) + """) v(name, sha256, said, ok)
""")
def files_read(spark: SparkSession, d: str) -> DataFrame:
    """A folder and a named file, listed and read; unreadable ones say so."""
    root = _files(spark)
    rows = document_text(list_documents(spark, [root, f"{root}/named.odd", root]))
    name = F.regexp_extract("path", "/files-[0-9a-f]+/(.*)$", 1)
    return rows.select(name.alias("name"), "sha256", F.replace("text", F.lit("\n"), F.lit("|")).alias("said"), F.col("error").isNotNull().alias("failed"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {len(c)})" for n, c, _ in _FILES if n in ("sub/c.py", "a.TXT")) + ") v(name, n)")
def sources_listed(spark: SparkSession, d: str) -> DataFrame:
    """Source files by extension without the excluded folders; each once."""
    root = _files(spark)
    rows = list_sources(spark, [root, f"{root}/sub"], ["PY", ".txt"])
    return rows.select(F.regexp_extract("path", "/files-[0-9a-f]+/(.*)$", 1).alias("name"), F.length("content").alias("n"))


# -- retrieval --------------------------------------------------------------

_HITS = f"""
    e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM e q, e c WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0),
    hits AS (SELECT query_id, rank, score, {_SQL_PATH} AS path, text FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 4),
    blocks AS (SELECT query_id, rank, path, '[source: ' || regexp_extract(path, '([^/]+)$', 1) || ' | relevance ' || printf('%.2f', score) || ']' || chr(10) || text AS block FROM hits),
    used AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM blocks),
    contexts AS (SELECT query_id, coalesce(string_agg(CASE WHEN used <= 6000 THEN block END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '') AS context,
                        count(CASE WHEN used <= 6000 THEN 1 END) AS blocks, string_agg(DISTINCT regexp_extract(path, '([^/]+)$', 1), ', ' ORDER BY regexp_extract(path, '([^/]+)$', 1)) AS sources
                 FROM used GROUP BY query_id)
"""


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), _path().alias("path"), "text")
    return rag.context(top_k(vectors, _asked(vectors), 4).join(docs, "vec_id"))


@query(f"WITH {_HITS} SELECT query_id, md5(context) AS context_md5, blocks FROM contexts")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d).select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), "blocks")


@query(f"WITH {_HITS} SELECT query_id, sources FROM contexts")
def sources_line(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d).select("query_id", "sources")


@query(f"""
    WITH {_HITS}, asked AS (SELECT item_id AS query_id, text AS question FROM benchmark)
    SELECT query_id, md5(CASE WHEN coalesce(context, '') <> '' THEN 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question
      ELSE '(no matching context found in the local store)' || chr(10) || chr(10) || 'Question: ' || question END) AS user_md5
    FROM asked LEFT JOIN contexts USING (query_id)
""")
def rag_messages(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = rag.messages(asked.join(_contexts(spark, d), "query_id", "left"))
    return rows.select("query_id", F.md5(F.col("user").cast("binary")).alias("user_md5"))


@query("""
    SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4
""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return rag.history(table(spark, d, "conversations"), 2).select("conv_id", "turn", "role", "text")


@query("""
    SELECT conv_id, string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id
""")
def transcript(spark: SparkSession, d: str) -> DataFrame:
    return rag.transcript(table(spark, d, "conversations"))


_EVENTS = (
    (1, 1, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), (1, 2, ": keep-alive"), (1, 3, "data: not json"),
    (1, 4, 'data: {"choices":[]}'), (1, 5, 'data: {"choices":[{"delta":{"content":"lo"}}]}'), (1, 6, "data: [DONE]"),
    (1, 7, 'data: {"choices":[{"delta":{"content":"never"}}]}'), (2, 1, 'data: {"choices":[{"delta":{"content":"x"}}]}'),
)


@query("""
    WITH l(stream_id, pos, line) AS (VALUES """ + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in _EVENTS) + """),
    p AS (SELECT *, trim(substr(line, 6)) AS payload FROM l WHERE starts_with(line, 'data:')),
    s AS (SELECT stream_id, min(CASE WHEN payload = '[DONE]' THEN pos END) AS stop FROM p GROUP BY stream_id)
    SELECT p.stream_id, string_agg(json_extract_string(TRY_CAST(payload AS JSON), '$.choices[0].delta.content'), '' ORDER BY pos) AS content
    FROM p JOIN s ON p.stream_id = s.stream_id WHERE stop IS NULL OR pos < stop GROUP BY p.stream_id
""")
def sse_parse(spark: SparkSession, d: str) -> DataFrame:
    return rag.sse_text(spark.createDataFrame(list(_EVENTS), "stream_id int, pos int, line string"))


# -- settings ---------------------------------------------------------------

_LAYER_ROWS = (
    ("url", 0, "", "--flag"), ("url", 1, "http://env", "$LLM_API_URL"), ("url", 2, "http://near", "/a/b/.cfg/config.json"),
    ("model", 2, "m-near", "/a/b/.cfg/config.json"), ("model", 3, "m-far", "/a/.cfg/config.json"), ("model", 9, "m-default", "default"),
    ("api_key", 3, "secret", "/a/.cfg/config.json"), ("timeout", 9, "120", "default"), ("verify_ssl", 1, "off", "$LLM_VERIFY"),
)


@query("""
    WITH l(key, rank, value, source) AS (VALUES """ + ", ".join(f"('{a}', {b}, '{c}', '{e}')" for a, b, c, e in _LAYER_ROWS) + """),
    r AS (SELECT key, arg_min(value, rank) AS value, arg_min(source, rank) AS source FROM l WHERE value <> '' GROUP BY key)
    SELECT key, source, CASE WHEN key = 'api_key' THEN 'set' WHEN key = 'verify_ssl' THEN 'false' ELSE value END AS shown,
      CASE WHEN source = 'default' THEN '(default)' WHEN source = '--flag' THEN '(this command)' WHEN source LIKE '$%' THEN '(' || source || ')'
           WHEN source = '/a/b/.cfg/config.json' THEN '(here)' ELSE '(inherited from /a)' END AS origin FROM r
""")
def settings_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = settings.resolve(spark.createDataFrame(list(_LAYER_ROWS), "key string, rank int, value string, source string"))
    kind = F.when(F.col("key") == "verify_ssl", "bool").otherwise("str")
    return rows.select(
        "key", "source", settings.shown(F.col("value"), kind, F.col("key") == "api_key").alias("shown"),
        settings.origin(F.col("source"), "/a/b/.cfg").alias("origin"),
    )


_JOBS = (
    (1, '{"include":["src"],"threshold":0.8,"url":"x","colour":1}'), (2, '{"timeout":3,"verify_ssl":true,"top_n":5}'), (3, '{"include":[]}'),
)
_KNOWN = [f for f in settings.Job.__dataclass_fields__]


@query("""
    WITH j(job_id, json) AS (VALUES """ + ", ".join(f"({a}, '{b}')" for a, b in _JOBS) + """), k AS (SELECT job_id, unnest(json_keys(json)) AS key FROM j)
    SELECT j.job_id, coalesce(string_agg(CASE WHEN key NOT IN (""" + ", ".join(f"'{x}'" for x in (*_KNOWN, *settings.RETIRED_KEYS)) + """) THEN key END, ',' ORDER BY key), '') AS unknown,
      coalesce(string_agg(CASE WHEN key IN (""" + ", ".join(f"'{x}'" for x in settings.RETIRED_KEYS) + """) THEN key END, ',' ORDER BY key), '') AS retired
    FROM j LEFT JOIN k ON j.job_id = k.job_id GROUP BY j.job_id
""")
def job_schema_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = settings.key_diff(spark.createDataFrame(list(_JOBS), "job_id int, json string"), _KNOWN)
    return rows.select("job_id", F.array_join("unknown", ",").alias("unknown"), F.array_join("retired", ",").alias("retired"))


_RAW = ("1", "0", " False ", "no", "OFF", "", "yes", "12", " -7 ", "1.5", "x")


@query("""
    SELECT raw, lower(trim(raw)) NOT IN ('0', 'false', 'no', 'off', '') AS as_bool,
           CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(raw) AS INTEGER) END AS as_int
    FROM (VALUES """ + ", ".join(f"('{x}')" for x in _RAW) + """) v(raw)
""")
def env_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _RAW], "raw string")
    return rows.select("raw", settings.parse_bool(F.col("raw")).alias("as_bool"), settings.parse_int(F.col("raw")).alias("as_int"))


_URLS = ("http://h/v1", "http://h/v1/", "http://h/v1/chat/completions", "http://h/v1/embeddings//", "http://h/completions")


@query("""
    SELECT url, regexp_replace(regexp_replace(url, '/+$', ''), '(/chat/completions|/embeddings|/completions)$', '') || '/embeddings' AS endpoint
    FROM (VALUES """ + ", ".join(f"('{x}')" for x in _URLS) + """) v(url)
""")
def endpoint_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _URLS], "url string")
    return rows.select("url", T.endpoint(F.col("url"), "/embeddings").alias("endpoint"))


@query(f"""
    WITH {_HITS}, asked AS (SELECT item_id AS query_id, text AS question FROM benchmark)
    SELECT query_id, md5(CASE WHEN coalesce(context, '') <> '' THEN 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question ELSE question END) AS user_md5
    FROM asked LEFT JOIN contexts USING (query_id)
""")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = rag.messages(asked.join(_contexts(spark, d), "query_id", "left"), rag.PLAIN_SYSTEM, chat=True)
    return rows.select("query_id", F.md5(F.col("user").cast("binary")).alias("user_md5"))


class _Service(http.server.BaseHTTPRequestHandler):
    """A stand-in for the embeddings and chat services: a text's vector is its length
    and 1, in rows out of order; an answer is the last message in capitals."""

    def do_POST(self) -> None:
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(200)
        self.end_headers()
        if self.path.endswith("/embeddings"):
            rows = [{"index": k, "embedding": [len(t), 1]} for k, t in enumerate(body["input"])]
            self.wfile.write(json.dumps({"data": rows[::-1]}).encode())
            return
        said = body["messages"][-1]["content"].upper()
        if body["stream"]:
            for word in said.split(" "):
                self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': word}}]})}\n\n".encode())
            self.wfile.write(b"data: [DONE]\n\n")
        else:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": said}}]}).encode())

    def log_message(self, *_: object) -> None:
        pass


@contextlib.contextmanager
def _service() -> Iterator[str]:
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}/v1"
    finally:
        server.shutdown()


@query("""
    SELECT sha256(text) AS hash, round(length(text) / sqrt(length(text) ** 2 + 1), 5) AS first_value
    FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
""")
def service_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from a service on this machine, batch by batch."""
    with _service() as url:
        texts = _texts(spark, d).select("hash", "text").dropDuplicates(["hash"])
        found = materialize(embed.embed(texts, embed.EndpointEmbedder(f"{url}/embeddings", "m", batch=16)), "service")
    return found.select("hash", F.round(F.col("vector")[0].cast("double"), 5).alias("first_value"))


@query("SELECT * FROM (VALUES ('whole', 'NINE ISLES'), ('stream', 'NINEISLES')) v(mode, content)")
def service_chat(spark: SparkSession, d: str) -> DataFrame:
    asked = [{"role": "user", "content": "nine isles"}]
    with _service() as url:
        service = chat.ChatEndpoint(f"{url}/chat/completions", "m")
        rows = [("whole", service.answer(asked)), ("stream", "".join(service.stream(asked)))]
    return spark.createDataFrame(rows, "mode string, content string")


_FOLDERS = ("/", "/a", "/a/b", "/a/bc", "/a/b/c", "/x")


@query("""
    SELECT folder, 4 - len(string_split(folder, '/')) AS distance FROM (VALUES """ + ", ".join(f"('{x}')" for x in _FOLDERS) + """) v(folder)
    WHERE folder = '/' OR '/a/b/c' = folder OR starts_with('/a/b/c', folder || '/')
""")
def settings_chain(spark: SparkSession, d: str) -> DataFrame:
    return settings.config_chain(spark.createDataFrame([(x,) for x in _FOLDERS], "folder string"), "/a/b/c")


_HELD = (("bool", "false"), ("bool", "0"), ("bool", '"x"'), ("int", "7"), ("int", "true"), ("int", '"7"'), ("str", '""'), ("str", '"v"'), ("str", "null"), ("str", "3"))


@query("""
    SELECT kind, value, CASE kind WHEN 'bool' THEN value IN ('true', 'false') WHEN 'int' THEN regexp_matches(value, '^-?[0-9]+$')
      ELSE value <> '""' AND starts_with(value, '"') END AS holds
    FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in _HELD) + """) v(kind, value)
""")
def setting_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, v, settings.Setting("s", "S", k).holds(json.loads(v))) for k, v in _HELD]
    return spark.createDataFrame(rows, "kind string, value string, holds boolean")


_WRITES = ({"url": "u", "model": ""}, {"model": "m", "api_key": None}, {"url": "", "timeout": 5})


@query("SELECT * FROM (VALUES ('url', 'u'), ('model', 'm'), ('timeout', '5')) v(key, value)")
def settings_written(spark: SparkSession, d: str) -> DataFrame:
    """Writes merge, and what is empty changes nothing."""
    with tempfile.TemporaryDirectory() as folder:
        for values in _WRITES:
            held = settings.merge_write(f"{folder}/x/config.json", values)
    return spark.createDataFrame([(k, str(v)) for k, v in held.items()], "key string, value string")


_OVERRIDES = (
    (1, 0.9, True, None, False, None), (2, 0.9, True, 0.5, True, 3), (3, 0.7, False, None, True, 0), (4, 0.7, False, 0.0, False, None),
)


@query("""
    SELECT job_id, coalesce(flag, threshold) AS threshold, filter_callers AND NOT off AS filter_callers, top_n
    FROM (VALUES """ + ", ".join(
        f"({a}, {b}::DOUBLE, {str(c).lower()}, {'NULL' if e is None else e}::DOUBLE, {str(f).lower()}, {'NULL' if g is None else g}::INTEGER)" for a, b, c, e, f, g in _OVERRIDES
    ) + """) v(job_id, threshold, filter_callers, flag, off, top_n)
""")
def job_overrides(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for job_id, threshold, callers, flag, off, top in _OVERRIDES:
        job = settings.Job(threshold=threshold, filter_callers=callers).overridden(threshold=flag, no_filter_callers=off, top_n=top)
        rows.append((job_id, job.threshold, job.filter_callers, job.top_n))
    return spark.createDataFrame(rows, "job_id int, threshold double, filter_callers boolean, top_n int")


@query("""
    WITH j(job_id, json) AS (VALUES """ + ", ".join(f"({a}, '{b}')" for a, b in _JOBS) + """)
    SELECT job_id, f.field, CASE WHEN list_contains(json_keys(json), f.field) THEN json_extract(json, '$.' || f.field)::VARCHAR ELSE f.value END AS value
    FROM j, (VALUES """ + ", ".join(f"('{k}', '{json.dumps(v, separators=(',', ':'))}')" for k, v in dataclasses.asdict(settings.Job()).items()) + """) f(field, value)
""")
def job_update(spark: SparkSession, d: str) -> DataFrame:
    """Updated job files: every field, given or by default, and nothing else."""
    rows = []
    with tempfile.TemporaryDirectory() as folder:
        for job_id, text in _JOBS:
            path = Path(folder, "job.json")
            path.write_text(text)
            settings.Job.update(str(path))
            rows += [(job_id, k, json.dumps(v, separators=(",", ":"))) for k, v in json.loads(path.read_text()).items()]
    return spark.createDataFrame(rows, "job_id int, field string, value string")


_CHECKED = (("[]", "[]", "pairwise", "text"), ("s", "[]", "pairwise", "text"), ("s", ".c", "clusters", "json"), ("s", ".c", "tree", "json"), ("s", ".c", "pairwise", "xml"))


@query("""
    SELECT include, extensions, report, output, include <> '[]' AND extensions <> '[]' AND report IN ('pairwise', 'clusters') AND output IN ('text', 'json', 'markdown') AS sound
    FROM (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}', '{e}')" for a, b, c, e in _CHECKED) + """) v(include, extensions, report, output)
""")
def job_checks(spark: SparkSession, d: str) -> DataFrame:
    def sound(a: str, b: str, c: str, e: str) -> bool:
        try:
            settings.Job(include=[] if a == "[]" else [a], extensions=[] if b == "[]" else [b], report=c, output=e).check()
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(*x, sound(*x)) for x in _CHECKED], "include string, extensions string, report string, output string, sound boolean")


_NEEDED = (("u", "m"), ("", "m"), ("u", ""), ("", ""))


@query("""
    SELECT url, model, concat_ws(', ', CASE WHEN url = '' THEN 'url' END, CASE WHEN model = '' THEN 'model' END) AS missing
    FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _NEEDED) + """) v(url, model)
""")
def settings_required(spark: SparkSession, d: str) -> DataFrame:
    def missing(url: str, model: str) -> str:
        try:
            settings.require({"url": url, "model": model}, "url", "model")
        except ValueError as e:
            return str(e).removeprefix("not set: ")
        return ""

    return spark.createDataFrame([(u, m, missing(u, m)) for u, m in _NEEDED], "url string, model string, missing string")


_BUDGETS = tuple((n, b) for n in (1, 10, 1000, 4000) for b in (0, 1, 16_000, 1 << 31))


@query("""
    SELECT n, budget, CASE WHEN budget = 0 THEN n ELSE greatest(1, least(n, budget // (4 * n))) END AS rows
    FROM (VALUES """ + ", ".join(f"({n}, {b})" for n, b in _BUDGETS) + """) v(n, budget)
""")
def memory_budget(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, b, block_rows(n, b)) for n, b in _BUDGETS], "n long, budget long, rows long")


@query("SELECT user_id, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY user_id")
def event_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last-wins upsert on an event table, keyed by user."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("hash"), F.lit("e").alias("model"), F.col("event_id").alias("seq"), "user_id")
    counts = rows.groupBy("user_id").agg(F.count("*").alias("events"))
    last = embed.cache_upsert(rows.where("false"), rows)
    return last.select("user_id", F.col("seq").alias("last_event")).join(counts, "user_id")
