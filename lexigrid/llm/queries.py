"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, filter_audit, html_text, jaccard_join, lm_scores, near_dedup, packing, quality, resampling, substring_dedup, token_counts, token_files, toxicity,
)
from .common import fresh_path, read_table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_TOKENS = 2048
#: Passages of so many words, many of which have under 400 bytes, are told of.
PASSAGE_WORDS = 51


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    rows = token_files.read_token_files(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), marks=PASSAGE_WORDS))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    packed = packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(read_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=5, seed=42)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"), percent=90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_token_counts": op5_token_counts,
        "op6_token_files": op6_token_files,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_packing": op8_packing,
        "op9_lm_scores": op9_lm_scores,
        "op10_html_text": op10_html_text,
        "op11_target_resampling": op11_target_resampling,
        "op12_filter_audit": op12_filter_audit,
        "op13_jaccard_join": op13_jaccard_join,
    }


#: Links of all pairs that share a shingle, and what is reachable by them.
OP1_SQL = r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN w[k : k + 4] ELSE w END AS s
                 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
    roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id,
           d.doc_id = least(d.doc_id, coalesce(root, d.doc_id)) AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""

#: The same for shingles of three words.
OP13_SQL = r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[k : k + 2] ELSE w END AS s
                 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
    roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""


#: CRC-32 is computed a half byte at a time over the hexadecimal digits of the features.
OP11_SQL = r"""
    WITH halves AS (SELECT list_transform(range(16), lambda v: list_reduce(list_prepend(v, [1, 2, 3, 4]),
                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS half),
    lowered AS (SELECT true AS own, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
                UNION ALL SELECT false, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
    words AS (SELECT own, doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM lowered),
    runs AS (SELECT own, doc_id, array_to_string(w[i : i + k - 1], ' ') AS f
             FROM (SELECT own, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS v(k))),
    counted AS (SELECT own, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
    digits AS (SELECT f, list_transform(range(1, length(hex(f)) + 1), lambda i: strpos('0123456789ABCDEF', substr(hex(f), CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END, 1)) - 1) AS d
               FROM (SELECT DISTINCT f FROM counted)),
    hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, d), lambda c, x: xor(c >> 4, half[(xor(c, x) & 15) + 1])), 4294967295) % 10000 AS bucket
               FROM digits, halves),
    placed AS (SELECT own, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
    sums AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
    totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM sums, totals),
    weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE own GROUP BY doc_id),
    scored AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
               FROM words d LEFT JOIN weighed USING (doc_id) WHERE own),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

#: The filters applied in every order, a step at a time, to counts of failed filters.
OP12_SQL = r"""
    WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    judged AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
               100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
               coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM docs),
    said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    counts AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM judged LEFT JOIN said USING (doc_id) GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT o, step, list_transform(o[1 : step - 1], lambda x: ascii(x) - 64) AS before, ascii(o[step]) - 64 AS own FROM orders, range(1, 6) AS r(step)),
    marked AS (SELECT part, o, step, own, n, good, toxic, fails[own] AS failing,
               coalesce(list_bool_or(list_transform(before, lambda k: fails[k])), false) AS gone,
               len(list_filter(fails, lambda f: f)) = 1 AS single FROM counts, steps),
    summed AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (failing AND single), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0)::BIGINT AS good_lost,
               coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost FROM marked GROUP BY part, o, step, own)
    SELECT part, array_to_string(o, '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute
    force, the tokenizers library, round trips and held-out labels."""
    return {"op1_minhash_near_dedup": OP1_SQL, "op11_target_resampling": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_jaccard_join": OP13_SQL}
