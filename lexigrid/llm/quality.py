"""Operator 2: quality rules as weak supervision, in DataFrame functions only.

Rules look at a document's measures and vote that it is good (1), that it is bad
(-1), or abstain (0).  Expectation-maximisation over the counts of vote patterns
estimates how each rule votes on good and on bad documents; a document's verdict
is its posterior probability of being good.  A pattern is one of three votes of
each of eight rules, so the counts are at most 3^8 rows whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

#: White space of the word definition, for trimming and for splitting.
_SPACE = " \t\n\x0b\x0c\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Words of a block in which different words are counted, so that a long text, which
#: comes back to its words, is measured like a short one.
BLOCK = 200
#: Base rules: least words, and most percent of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: EM: rounds, first share of bad documents, and added counts.
ROUNDS, FIRST_BAD, SMOOTH = 40, 0.15, 1.0
#: First guess of how often a rule votes (-1, 0, 1) on bad and on good documents.
FIRST_VOTES = {-1: (0.40, 0.02), 0: (0.35, 0.28), 1: (0.25, 0.70)}


def measures(docs: DataFrame) -> DataFrame:
    """Word, symbol, line and repetition measures of every whole text.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_distinct, n_upper, n_shouts``; ``n_distinct`` adds up the different
    words of blocks of BLOCK words; null and empty texts measure 0; other columns are
    not read; repeated rows and null ids are kept.
    """
    trimmed = F.trim(F.col("text"), F.lit(_SPACE))
    step = texts(docs).select("doc_id", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT)).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != "")
    joined = F.array_join("w", "")
    step = step.select(
        "doc_id", "w", F.size("w").cast("long").alias("n_words"), lines.alias("lines"), joined.alias("joined"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
    )

    # Hashes of 2, 4 and 8 words from those of half as many.
    def doubled(column: str, reach: int) -> Column:
        h = F.col(column)
        left = F.greatest(F.size(h) - F.lit(reach), F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(1 + reach), left), lambda a, b: F.xxhash64(a, b))

    step = step.withColumn("h2", doubled("h1", 1)).withColumn("h4", doubled("h2", 2)).withColumn("h8", doubled("h4", 4))
    pairs = F.when(
        F.size(F.array_distinct("h8")) < F.size("h8"),
        F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    step = step.select(
        "doc_id", "n_words",
        F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(F.regexp_replace("joined", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct(F.transform("h1", lambda h, i: F.xxhash64(h, F.floor(i / BLOCK))))).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("joined", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (F.length("joined") - F.length(F.regexp_replace("joined", "!+", ""))).cast("long").alias("n_shouts"),
        pairs.alias("s"),
    )
    s, m = F.col("s"), F.size("s")
    twins = F.zip_with(
        F.slice(s, F.lit(1), m - 1), F.slice(s, F.lit(2), m - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    step = step.withColumn("at", F.when(s.isNotNull(), F.array_sort(F.array_distinct(F.flatten(twins)))))
    at, k = F.col("at"), F.size("at")
    gaps = F.zip_with(F.slice(at, F.lit(1), k - 1), F.slice(at, F.lit(2), k - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.when(at.isNull(), F.lit(0)).otherwise(WINDOW + F.aggregate(gaps, F.lit(0), lambda x, y: x + y))
    return step.withColumn("n_repeat_words", covered.cast("long")).drop("s", "at")


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules.  A rule without evidence either way abstains."""
    n, chars, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_lines")
    per_word = F.col("n_symbols") / n
    distinct = F.col("n_distinct") / n
    upper = F.col("n_upper") / chars
    length = F.col("word_chars") / n
    return {
        "symbols_per_word": _vote(per_word > 0.1),
        "symbol_share": _vote(F.col("n_symbols") / chars > 0.05),
        "repeated_windows": _vote(F.col("n_repeat_words") > 0.2 * n),
        "repeated_lines": _vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * lines)),
        "vocabulary": _vote((distinct < 0.35) & (n >= 20), distinct > 0.5),
        "capitals": _vote(upper > 0.3, upper < 0.1),
        "shouting": _vote(F.col("n_shouts") > 0.1 * n),
        "word_length": _vote((length < 3) | (length > 10), (length >= 4) & (length <= 8)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """EM over (votes, number of documents).

    Returns the log odds of good before any vote and, for each rule, what each
    vote adds to them.  Without documents the first guess is returned.
    """
    rules = len(patterns[0][0]) if patterns else 0
    bad_share = FIRST_BAD
    table = [{v: p for v, p in FIRST_VOTES.items()} for _ in range(rules)]
    total = sum(c for _, c in patterns)
    for _ in range(ROUNDS):
        counts = [{v: [SMOOTH * p[0], SMOOTH * p[1]] for v, p in FIRST_VOTES.items()} for _ in range(rules)]
        bad_total = SMOOTH * FIRST_BAD
        for pattern, c in patterns:
            odds = math.log(1 - bad_share) - math.log(bad_share)
            odds += sum(math.log(t[v][1]) - math.log(t[v][0]) for t, v in zip(table, pattern))
            good = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            bad_total += c * (1 - good)
            for k, v in zip(counts, pattern):
                k[v][0] += c * (1 - good)
                k[v][1] += c * good
        if not total:
            break
        bad_share = min(1 - 1e-6, max(1e-6, bad_total / (total + SMOOTH)))
        sums = [[sum(k[v][y] for v in k) for y in (0, 1)] for k in counts]
        table = [{v: (k[v][0] / s[0], k[v][1] / s[1]) for v in k} for k, s in zip(counts, sums)]
    return math.log(1 - bad_share) - math.log(bad_share), [
        {v: math.log(p[1]) - math.log(p[0]) for v, p in t.items()} for t in table
    ]


def judge(docs: DataFrame) -> DataFrame:
    """Measures, one vote column a rule, ``base_failed``, ``p_good`` and ``kept``.

    An empty table gives an empty result.  Too short and too repetitive texts
    fail the base rules and are not kept, whatever the votes say.
    """
    rules = votes()
    measured = materialize(measures(docs), "measures")
    voted = measured.select("*", *(c.alias(f"vote_{name}") for name, c in rules.items()))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    columns = [f"vote_{name}" for name in rules]
    counted = voted.groupBy(columns).count().collect()  # at most 3^8 rows
    patterns = sorted((tuple(r[c] for c in columns), r["count"]) for r in counted)
    prior, weights = estimate(patterns)
    odds = F.lit(prior)
    for column, w in zip(columns, weights):
        odds = odds + F.when(F.col(column) == -1, w[-1]).when(F.col(column) == 1, w[1]).otherwise(w[0])
    p_good = 1 / (1 + F.exp(-odds))
    return voted.select("*", base.alias("base_failed"), p_good.alias("p_good")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)
    )
