"""Text functions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at both ends as Python's ``str.strip`` sees it.
_ENDS = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def normalize(text: Column) -> Column:
    """Strip, and at most one blank line between paragraphs."""
    return F.regexp_replace(strip(text), "\n{3,}", "\n\n")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def decode(content: Column) -> Column:
    """UTF-8 with replacement characters for what is not."""
    return F.make_valid_utf8(content.cast("string"))


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(normalize(text), "\n\n"), strip)
    return F.filter(parts, lambda p: p != "")


def check_chunking(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")


def chunk(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Chunks of a text packed from its paragraphs.

    A paragraph longer than ``size`` is cut every ``size - overlap`` characters;
    what remains starts the next chunk.  A full chunk hands its last ``overlap``
    characters to the next.  Null gives null, a blank text no chunks.
    """
    check_chunking(size, overlap)
    step = size - overlap

    def add(state: Column, para: Column) -> Column:
        done, held = state["done"], state["held"]
        pieces = F.when(F.length(para) > size, F.ceil((F.length(para) - size) / F.lit(step)).cast("int")).otherwise(0)
        cut = F.when(
            pieces > 0,
            F.transform(F.sequence(F.lit(0), F.greatest(pieces - 1, F.lit(0))), lambda i: F.substring(para, i * step + 1, F.lit(size))),
        ).otherwise(F.array().cast("array<string>"))
        rest = F.when(pieces > 0, para.substr(pieces * step + 1, F.length(para))).otherwise(para)
        start = F.when(pieces > 0, "").otherwise(held)
        done = F.when((pieces > 0) & (held != ""), F.concat(done, F.array(held), cut)).otherwise(F.concat(done, cut))
        fits = F.length(start) + F.length(rest) + 2 <= size
        tail = F.right(start, F.lit(overlap)) if overlap else F.lit("")
        fresh = strip(F.concat(tail, F.lit("\n\n"), rest)) if overlap else rest
        return F.struct(
            F.when((start != "") & ~fits, F.concat(done, F.array(start))).otherwise(done).alias("done"),
            F.when(start == "", rest).when(fits, F.concat(start, F.lit("\n\n"), rest)).otherwise(fresh).alias("held"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    return F.aggregate(
        paragraphs(text), zero, add,
        lambda s: F.when(s["held"] != "", F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]),
    )


def lines(text: Column) -> Column:
    """Lines at newlines only, without carriage returns at their ends."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r+$", ""))


def windows(line_array: Column, width: int = 40, overlap: int = 8, min_lines: int = 4) -> Column:
    """``start, end, block`` of overlapping line windows, lines from 1.

    A window must have ``min_lines`` lines and one that is not blank; the last
    ends with the text.
    """
    step = max(width - overlap, 1)

    def cut(rows: Column) -> Column:
        n = F.size(rows)
        count = F.when(n <= width, 1).otherwise(F.ceil((n - width) / F.lit(step)) + 1).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(
                (i * step + 1).alias("start"), F.least(i * step + width, n).alias("end"),
                F.array_join(F.slice(rows, i * step + 1, F.lit(width)), "\n").alias("block"),
            ),
        )

    made = F.when(line_array.isNotNull(), _let(line_array, cut))
    return F.filter(made, lambda w: (w["end"] - w["start"] + 1 >= min_lines) & (strip(w["block"]) != ""))


def dedent(block: Column) -> Column:
    """Common leading spaces and tabs off every line; blank lines become empty."""
    rows = F.transform(F.split(block, "\n", -1), lambda x: F.regexp_replace(x, "^[ \t]+$", ""))
    ends = _let(
        F.transform(F.filter(rows, lambda x: x != ""), lambda x: F.regexp_extract(x, "^[ \t]*", 0)),
        lambda m: F.struct(F.array_min(m).alias("low"), F.array_max(m).alias("high")),
    )
    # The common beginning of the least and the greatest is that of all.
    shared = _let(
        ends,
        lambda e: F.aggregate(
            F.sequence(F.lit(0), F.least(F.length(e["low"]), F.length(e["high"]))), F.lit(0),
            lambda best, k: F.when((k > best) & (F.left(e["low"], k) == F.left(e["high"], k)), k).otherwise(best),
        ),
    )
    return _let(
        F.struct(rows.alias("rows"), F.coalesce(shared, F.lit(0)).alias("margin")),
        lambda s: F.array_join(F.transform(s["rows"], lambda x: x.substr(s["margin"] + 1, F.length(x))), "\n"),
    )


def unit_text(block: Column) -> Column:
    """A unit's block as it is embedded: dedented, no newlines at its ends."""
    return F.regexp_replace(dedent(block), "^\n+|\n+$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), ".(\\.[^.]+)$", 1))


def ref(path: Column, start: Column, end: Column, name: Column) -> Column:
    """``path:start-end`` and the name, if there is one."""
    label = F.when(name != "", F.concat(F.lit(" "), name)).otherwise("")
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), label)


def three_places(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.3f", value))


def endpoint(url: Column, path: str) -> Column:
    """Service address: one known ending and trailing slashes off, path on."""
    base = F.regexp_replace(F.regexp_replace(url, "/+$", ""), "(/chat/completions|/embeddings|/completions)$", "")
    return F.concat(base, F.lit("/" + path.lstrip("/")))
