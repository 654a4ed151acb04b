"""Operator 7: removal of bytes that repeat elsewhere, over all documents.

A string of ``least`` bytes that occurs twice occurs twice with the same anchor:
the least hash of the short strings inside it.  So every place of a text belongs
to the region of one anchor, and only regions with equal anchors need comparing.
Regions that are equal as a whole are found by counting their hashes.  Where
regions share an anchor and differ, one of each kind goes to a bucket of bounded
size, and the bucket's Burrows-Wheeler transform tells which strings repeat (see
:mod:`.bwt`).  An anchor with more text than a bucket holds is cut in batches;
after each batch's own transform, batches exchange the hashes of their strings
through partitions that no single anchor can heat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bwt import SEPARATOR, repeated
from .common import materialize, texts
from .token_ids import slices
from .words import _WHITE, POWER, hash_words, mix, tables, window_hashes

#: Bytes of the short strings that anchors are chosen from.
GRAM = 80
#: Words of the short strings that anchors of strings of words are chosen from.
WORD_GRAM = 12
#: Bytes of regions in a bucket, and of one anchor before it is cut in batches.
BUCKET_BYTES, BATCH_BYTES = 1 << 19, 4 << 20

_ANCHORS = "h long, kind long, n long, text_key binary, low long, high long, marks array<long>"


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least key of each window of ``width``, from block prefixes and suffixes."""
    n = len(key)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(rows, width)
    forward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _summed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of texts, their bytes one after another, and prefix sums for hashes."""
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    up, _ = tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
    return sizes, data, total


def anchors_of(sizes: np.ndarray, data: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the region, text, first and last start of each region."""
    gram = min(GRAM, least)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < least:
        return none
    _, down = tables(len(data) + 1)
    n = len(data) - gram + 1
    h = mix((total[gram:] - total[:n]) * down[:n])
    # By the upper half of the hash; among equal ones the first.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = least - gram + 1
    anchor = (_sliding_least(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    place = np.flatnonzero(np.arange(len(anchor)) + least <= ends[owner])
    if not len(place):
        return none
    at, own = anchor[place], owner[place]
    new = np.ones(len(place), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    low, high = place[first], place[np.append(first[1:], len(place)) - 1]
    at, own = at[first], own[first]
    # A region's bytes and where its anchor stands in them.
    whole = hash_words(data, low, high + least - low)
    kind = mix(whole * POWER + (at - low).astype(np.uint64))
    return h[at].view(np.int64), kind.view(np.int64), own, low - starts[own], high - starts[own]


def word_anchors(sizes: np.ndarray, data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the anchors of all strings of ``words`` words: the least hash
    of WORD_GRAM words in each, once a place.

    Equal strings of words have equal anchors, so a text none of whose anchors stands
    anywhere else shares no string of so many words.
    """
    ends = np.cumsum(sizes)
    white, edge = _WHITE[data], np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begins, stops = ~white, ~white
    begins[1:] &= white[:-1] | edge[1:-1]
    stops[:-1] &= white[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    gram = min(WORD_GRAM, words)
    if len(first) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(ends, first, "right")
    word = hash_words(data, first, last - first)
    n = len(word) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = h * POWER + word[k : k + n]
    h = mix(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    anchor = (_sliding_least(key, words - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.flatnonzero(owner[: len(anchor)] == owner[words - 1 :])
    at = np.unique(anchor[inside])
    return owner[at], h[at].view(np.int64)


def anchors(docs: DataFrame, least: int, marks: int = 0) -> DataFrame:
    """One row for each region; regions that repeat inside a text count ``n``
    times in one row, and their places are rows without an anchor.  With ``marks``
    a text's anchors of strings of so many words are one row with a ``low`` of -1."""
    names, marked = ["h", "kind", "n", "text_key", "low", "high", "marks"], pa.list_(pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, size=1 << 19):
                raw = [v.encode("utf-8", "surrogatepass") for v in values]
                keys = batch.column("text_key").slice(part.start, len(values))
                prepared = _summed(raw)
                if marks:
                    own, h = word_anchors(*prepared[:2], marks)
                    some, count = np.unique(own, return_counts=True)
                    held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(h, pa.int64()))
                    none, below = pa.nulls(len(some), pa.int64()), pa.array(np.full(len(some), -1))
                    yield pa.RecordBatch.from_arrays([none, none, none, keys.take(pa.array(some)), below, below, held], names)
                h, kind, own, low, high = anchors_of(*prepared, least)
                if not len(h):
                    continue
                order = np.lexsort((low, kind, h, own))
                same = np.zeros(len(order), bool)
                a, b = order[1:], order[:-1]
                same[1:] = (own[a] == own[b]) & (h[a] == h[b]) & (kind[a] == kind[b])
                lead = np.flatnonzero(~same)
                count = np.diff(np.append(lead, len(order)))
                often = np.repeat(count > 1, count)
                known = np.sort(order[often])  # by text and place
                joined = np.zeros(len(known), bool)
                joined[1:] = (own[known[1:]] == own[known[:-1]]) & (low[known[1:]] == high[known[:-1]] + 1)
                begin = np.flatnonzero(~joined)
                end = np.append(begin[1:], len(known))[: len(begin)] - 1
                lead = order[lead]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[lead], pa.int64()), pa.array(kind[lead], pa.int64()), pa.array(count, pa.int64()),
                        keys.take(pa.array(own[lead])), pa.array(low[lead], pa.int64()), pa.array(high[lead], pa.int64()),
                        pa.nulls(len(lead), marked),
                    ],
                    names,
                )
                if len(known):
                    blank = pa.nulls(len(begin), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            blank, blank, blank, keys.take(pa.array(own[known[begin]])),
                            pa.array(low[known[begin]], pa.int64()), pa.array(high[known[end]], pa.int64()), pa.nulls(len(begin), marked),
                        ],
                        names,
                    )

    return docs.mapInArrow(run, _ANCHORS)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return [(a, b - 1) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]


def _joined(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Regions one after another with separators, and where each starts."""
    gap = bytes([SEPARATOR])
    data = np.frombuffer(gap.join(group["region"]) + gap, np.uint8)
    starts = np.concatenate(([0], np.cumsum(group["region"].str.len().to_numpy() + 1)[:-1]))
    return data, starts


def _found(group: pd.DataFrame, flags: list[np.ndarray]) -> pd.DataFrame:
    """Places of the repeated strings of regions that occur once."""
    rows = [
        (key, low + a, low + b)
        for key, n, low, f in zip(group["text_key"], group["n"], group["low"], flags)
        if n == 1
        for a, b in _runs(f)
    ]
    return pd.DataFrame(rows, columns=["text_key", "low", "high"]).astype({"low": "int64", "high": "int64"})


def _flags(group: pd.DataFrame, least: int) -> list[np.ndarray]:
    data, starts = _joined(group)
    again = repeated(data, least)
    counts = (group["high"] - group["low"] + 1).tolist()
    return [again[s : s + c] for s, c in zip(starts.tolist(), counts)]


def _across_batches(regions: DataFrame, parts: int, least: int) -> DataFrame:
    """Repeats between batches of the same anchor, and inside each batch."""
    def hashes(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        data, starts = _joined(group)
        every = window_hashes(mix(data.astype(np.uint64) + np.uint64(1)), least)
        counts = (group["high"] - group["low"] + 1).to_numpy()
        at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return every[at], counts

    def send(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["kind", "text_key"])
        unique = np.unique(hashes(group)[0])
        part = unique % np.uint64(parts)
        return pd.DataFrame(
            {
                "batch": group["batch"].iloc[0],
                "part": np.arange(parts),
                "hashes": [unique[part == np.uint64(p)].tobytes() for p in range(parts)],
            }
        )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        sent = [np.frombuffer(raw, np.uint64) for raw in group["hashes"]]
        unique, counts = np.unique(np.concatenate(sent), return_counts=True)
        shared = unique[counts > 1]
        return pd.DataFrame({"batch": group["batch"], "shared": [s[np.isin(s, shared)].tobytes() for s in sent]})

    def decide(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["kind", "text_key"]).reset_index(drop=True)
        shared = np.concatenate([np.frombuffer(raw, np.uint64) for raw in answers["shared"]] or [np.zeros(0, np.uint64)])
        own, counts = hashes(group)
        elsewhere = np.split(np.isin(own, shared), np.cumsum(counts)[:-1])
        return _found(group, [a | b for a, b in zip(_flags(group, least), elsewhere)])

    sent = regions.groupBy("batch").applyInPandas(send, "batch long, part long, hashes binary")
    met = sent.groupBy("part").applyInPandas(meet, "batch long, shared binary")
    return regions.groupBy("batch").cogroup(met.groupBy("batch")).applyInPandas(decide, "text_key binary, low long, high long")


def repeated_places(keyed: DataFrame, least: int, marks: int = 0) -> DataFrame:
    """``text_key, low, high``: first and last starts of runs of repeated strings.
    With ``marks`` a text's number of anchors of so many words that stand elsewhere
    too is a row with that number, negative, as ``low``.

    What rows are joined to is written first: then Spark splits a frequent key's rows.
    """
    found = materialize(anchors(keyed, least, marks), "anchors")
    regions = found.where("kind IS NOT NULL")
    shared = regions.groupBy("h").agg(F.sum("n").alias("total"), (F.min("kind") != F.max("kind")).alias("mixed")).where("total > 1")
    shared = materialize(shared, "shared")
    candidates = materialize(regions.join(shared.select("h", "mixed"), "h"), "candidates")
    kinds = candidates.groupBy("h", "kind", "mixed").agg(
        F.sum("n").alias("n"), F.min(F.struct("text_key", "low", "high")).alias("x")
    )
    whole = candidates.join(kinds.where("n > 1").select("h", "kind"), ["h", "kind"]).select("text_key", "low", "high").distinct()
    mixed = kinds.where("mixed").select("h", "kind", "n", "x.*", (F.col("x.high") - F.col("x.low") + least + 1).alias("bytes"))
    per_anchor = mixed.groupBy("h").agg(F.sum("bytes").alias("anchor_bytes"), F.min("n").alias("least_n")).where("least_n = 1")
    per_anchor = materialize(per_anchor, "per-anchor")
    wanted = materialize(mixed.join(per_anchor.select("h", "anchor_bytes"), "h"), "wanted")
    room = wanted.agg(F.sum("bytes"), F.sum(F.when(F.col("anchor_bytes") > BATCH_BYTES, F.col("bytes")))).first()
    buckets, hot_bytes = 1 + (room[0] or 0) // BUCKET_BYTES, room[1] or 0
    one_text = keyed.select("text_key", "text").dropDuplicates(["text_key"])
    cut = one_text.join(wanted, "text_key").select(
        "text_key", "h", "kind", "n", "low", "high", "anchor_bytes",
        F.expr(f"substring(cast(text AS binary), cast(low + 1 AS int), cast(high - low + {least} AS int))").alias("region"),
    )
    batches = F.ceil(F.col("anchor_bytes") / BATCH_BYTES)
    cut = cut.withColumn(
        "batch",
        F.when(F.col("anchor_bytes") > BATCH_BYTES, F.xxhash64("h", F.pmod(F.xxhash64("kind"), batches))).otherwise(
            F.pmod(F.xxhash64("h"), F.lit(buckets))
        ),
    )

    def expand(group: pd.DataFrame) -> pd.DataFrame:
        return _found(group, _flags(group, least))

    places = "text_key binary, low long, high long"
    if hot_bytes:
        cut = materialize(cut, "regions")
        hot = _across_batches(cut.where(F.col("anchor_bytes") > BATCH_BYTES), 1 + hot_bytes // BATCH_BYTES, least)
        cool = cut.where(F.col("anchor_bytes") <= BATCH_BYTES).groupBy("batch").applyInPandas(expand, places)
        inside = cool.unionAll(hot)
    else:
        inside = cut.groupBy("batch").applyInPandas(expand, places)
    places = found.where("h IS NULL AND low >= 0").select("text_key", "low", "high").unionAll(whole).unionAll(inside)
    if not marks:
        return places
    marked = found.where("low = -1").select("text_key", F.explode("marks").alias("h"))
    again = materialize(marked.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "marks")
    number = marked.join(again, "h").groupBy("text_key").agg(F.size(F.collect_set("h")).cast("long").alias("n"))
    return places.unionAll(number.select("text_key", -F.col("n"), F.lit(None).cast("long")))


def word_windows(raw: list[bytes], words: int, below: int) -> tuple[np.ndarray, ...]:
    """Hash, text, start and end of all strings of ``words`` whole words that have
    fewer than ``below`` bytes."""
    data = np.frombuffer(b"".join(r + b" " for r in raw), np.uint8)
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    edge = np.flatnonzero(np.diff(_WHITE[data].astype(np.int8), prepend=1))
    first, last = edge[0::2], edge[1::2]  # every text ends with a space
    a, b = first[: max(0, len(first) - words + 1)], last[words - 1 :]
    own = np.searchsorted(starts, a, "right") - 1
    chosen = np.flatnonzero((b - a < below) & (b < starts[own + 1]))
    a, b, own = a[chosen], b[chosen], own[chosen]
    if not len(first):
        return np.zeros(0, np.int64), own, a, b
    # Words with the white space after them, the last one without.
    whole = hash_words(data, first, np.append(first[1:], len(data)) - first)
    h = hash_words(data, first, last - first)[words - 1 :][chosen]
    if words > 1:
        h = mix(window_hashes(whole, words - 1)[chosen] * POWER + h)
    return h.view(np.int64), own, a - starts[own], b - starts[own]


def short_places(keyed: DataFrame, words: int, least: int) -> DataFrame:
    """``text_key, low, high``: repeated strings of ``words`` words that have fewer
    than ``least`` bytes, of which ``high`` is the end less ``least``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, size=1 << 19):
                h, own, low, end = word_windows([v.encode("utf-8", "surrogatepass") for v in values], words, least)
                keys = batch.column("text_key").slice(part.start, len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), keys.take(pa.array(own)), pa.array(low, pa.int64()), pa.array(end - least, pa.int64())],
                    ["h", "text_key", "low", "high"],
                )

    found = materialize(keyed.mapInArrow(run, "h long, text_key binary, low long, high long"), "word-windows")
    # Written, so that Spark can split the rows of a very frequent hash in the join.
    again = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "word-windows-again")
    return found.join(again, "h").select("text_key", "low", "high")


def remove_repeats(docs: DataFrame, least: int = 400, keep: tuple[str, ...] = (), as_text: bool = False, words: int = 0, marks: int = 0) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_bytes, n_shared_anchors`` of every row.

    With ``as_text`` the rest is a string ``kept_text`` instead, without the
    parts of characters that a cut leaves.

    Bytes covered by a string of ``least`` bytes that also starts anywhere else,
    in the same text or another, are removed, and with ``words`` those covered by a
    string of so many whole words that does, though it has fewer bytes; ``n_spans``
    counts the maximal removed runs.  ``n_shared_anchors`` tells more and removes
    nothing: with ``marks``, of how many anchors of strings of so many words others
    stand elsewhere; 0 means that no such string of the text does.  Null texts are empty; texts shorter than ``least`` lose
    nothing; repeated rows are documents like others, so long ones lose all they
    share; null ids are kept; an empty table gives an empty result.  Columns named
    in ``keep`` are carried in a struct ``carried``, where their names clash with
    nothing; others are not read.
    """
    rest_name = "kept_text" if as_text else "kept_bytes"
    carried = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("carried")] if keep else []
    keyed = texts(docs, *carried).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    places = repeated_places(keyed.select("text_key", "text"), least, marks)
    if words:
        places = places.unionAll(short_places(keyed.select("text_key", "text"), words, least))
    at = F.when(F.col("low") >= 0, F.struct("low", "high"))
    places = places.groupBy("text_key").agg(
        F.sort_array(F.collect_set(at)).alias("places"), F.sum(F.when(F.col("low") < 0, -F.col("low"))).alias("shared")
    )
    places = materialize(places, "places")
    both = keyed.join(places, "text_key", "left")
    lows, highs = F.transform("places", lambda p: p["low"]), F.transform("places", lambda p: p["high"])
    names = ["carried"] if keep else []
    both = both.select("doc_id", "text", *names, lows.alias("lows"), highs.alias("highs"), F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch):
                own = batch.slice(part.start, len(values))
                out = [_cut(v.encode("utf-8", "surrogatepass"), a, b, least) for v, a, b in zip(values, own.column("lows").to_pylist(), own.column("highs").to_pylist())]
                rest = [x[3] for x in out]
                rest = pa.array([r.decode("utf-8", "ignore") for r in rest], pa.string()) if as_text else pa.array(rest, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.int64()), rest, own.column("shared"), *(own.column(c) for c in names),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", rest_name, "n_shared_anchors", *names],
                )

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {rest_name} {'string' if as_text else 'binary'}, n_shared_anchors long"
    fields = StructType.fromDDL(schema).fields + ([both.schema["carried"]] if keep else [])
    return both.mapInArrow(run, StructType(fields))


def _cut(raw: bytes, lows: list[int] | None, highs: list[int] | None, least: int) -> tuple[int, int, int, bytes]:
    if not lows:
        return len(raw), 0, 0, raw
    kept, spans, at, stop = [], 0, 0, -1
    for low, high in zip(lows, highs):
        if low > stop:
            kept.append(raw[at:low])
            spans += 1
        stop = max(stop, high + least)
        at = stop
    kept.append(raw[at:])
    rest = b"".join(kept)
    return len(raw), len(raw) - len(rest), spans, rest


def digest(rows: DataFrame) -> DataFrame:
    """The digest columns of :func:`remove_repeats`."""
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), "n_shared_anchors")
