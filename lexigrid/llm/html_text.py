"""Operator 10: main text of web pages by shallow block features and a tree.

A page is cut into flat text blocks at block-level tags.  A block's features are
its word count and link density, those of the blocks before and after it, whether
it is inside an article and the page has one, and how clearly element names, classes
and ids around it say that it is something else.  A decision tree, trained here on
the blocks of a small table of labelled pages, tells content from the rest.

A class counts as a whole: ``cookie-notice`` names a notice, ``share-price`` only
half, and what encloses the page's article or most of its text says nothing.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import slices

# HTML element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; those of RAW run to the end of
#: the page if they have no end tag, those of EMPTY may be closed by their own tag.
SILENT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "select", "textarea", "button", "title", "canvas", "audio", "video")
RAW, EMPTY = frozenset(("script", "style")), frozenset(("svg", "math"))
#: Elements that hold no article text.
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
#: Words of class, id or role that name such parts, and words that say nothing
#: beside them.
HINTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "disclaimer footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo "
    "promoted promotion related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget "
    "complementary contentinfo search alert dialog form login signup toc responses discussion disqus gdpr paywall".split()
)
PLAIN = frozenset(
    "site page block box container wrapper wrap list item items section region area inner outer top bottom left right "
    "global primary secondary post posts article articles links link stories buttons button slot unit bar panel text the".split()
)
#: Classes of this mark and more cut a text that they stand in.
WHOLE_MARK = 0.75
#: Without an article, what holds this share of a page's words says nothing.
MOST = 2 / 3
_CONTAINERS = BLOCKS - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hr"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<silent>{'|'.join(SILENT)})(?=[\s/>])(?P<own>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>"
    r"|<!\[CDATA\[|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in SILENT}
_ATTRIBUTES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "page_has_article", "mark",
)

#: The labelled table: pages, and of each block the elements around it, its words,
#: how many of them are linked, and whether it is content.
LABELLED = """
body/nav/ul/li 1 1 0 | body/nav/ul/li 2 2 0 | body/nav/ul/li 1 1 0 | body/div.ad 9 0 0 | body/article/h1 8 0 1 | body/article/p 90 0 1
body/article/p 1 0 1 | body/article/p 14 0 1 | body/article/p 210 6 1 | body/article/div.cookie-notice 6 0 0 | body/article/p 3 0 1 | body/footer 11 0 0

body/header/h1 3 3 0 | body/header/p 7 0 0 | body/main/h2 5 0 1 | body/main/p 60 4 1 | body/main/p.lead-share 25 0 1 | body/main/p 2 0 1
body/main/ul/li 9 0 1 | body/main/ul/li 6 0 1 | body/main/ul/li 12 3 1 | body/main/p 45 0 1 | body/main/aside/p 40 2 0 | body/main/p 33 0 1
body/main/div.related-posts/ul/li 5 5 0 | body/main/div.related-posts/ul/li 7 7 0 | body/footer/p 20 4 0

body/div.menu/ul/li 1 1 0 | body/div.menu/ul/li 1 1 0 | body/div.menu/ul/li 2 2 0 | body/h1 6 0 1 | body/p 80 3 1 | body/p 55 0 1 | body/p 9 0 1
body/p 120 5 1 | body/h2 4 0 1 | body/p 70 0 1 | body/p 3 3 0 | body/p 4 4 0 | body/div.site-footer 12 2 0

body/table/tr/td 2 2 0 | body/table/tr/td 1 1 0 | body/table/tr/td 3 3 0 | body/table/tr/td 2 2 0 | body/table/tr/td/h2 7 0 1
body/table/tr/td/p 64 2 1 | body/table/tr/td/p 130 0 1 | body/table/tr/td/p 18 0 1 | body/table/tr/td/p 75 8 1 | body/table/tr/td 5 5 0
body/table/tr/td 6 5 0 | body/table/tr/td 4 4 0 | body/table/tr/td 8 2 0

body/div/ul/li 3 3 0 | body/div/ul/li 2 2 0 | body/div/h3 6 6 0 | body/div/p 22 16 0 | body/div/h3 7 7 0 | body/div/p 24 18 0 | body/div/h3 5 5 0
body/div/p 30 20 0 | body/div/p 2 2 0 | body/div/p 6 0 0

body/article/h1 4 0 1 | body/article/p 1 0 1 | body/article/p 5 0 1 | body/article/p 7 2 1 | body/article/p 400 9 1 | body/article/p 2 0 1
body/article/ul/li 4 4 0 | body/article/ul/li 5 5 0 | body/article/ul/li 3 3 0 | body/article/ul/li 6 6 0 | body/div/p 60 0 0 | body/div/p 90 1 0
body/div/p 14 0 0 | body/div/p 150 0 0 | body/section/p 1 1 0 | body/section/p 30 0 0

body/div.nav-bar/ul/li 2 2 0 | body/div.content/h1 9 0 1 | body/div.content/p 44 0 1 | body/div.content/p 16 1 1 | body/div.content/p 60 0 1
body/div.content/div.share-price/p 11 0 1 | body/div.content/p 38 2 1 | body/div.sidebar/p 40 3 0 | body/div.sidebar/p 25 25 0
body/div.comments/p 70 0 0 | body/div.comments/p 35 0 0 | body/div.comments/p 5 0 0

body/form/p 4 0 0 | body/article/h1 3 0 1 | body/article/div.social-sciences/p 12 0 1 | body/article/p 30 1 1 | body/article/div.share-price/p 4 0 1
body/article/div.no-ads/p 150 0 1 | body/article/p.newsletter 14 1 0 | body/article/div.sponsored/p 50 0 0 | body/article/p 10 0 1
body/article/p 1 1 1 | body/article/p 70 0 1 | body/article/div.comments/p 200 0 0 | body/article/div.comments/p 8 0 0 | body/dialog/p 18 2 0

body/div/p 2 0 0 | body/div/p 3 3 0 | body/div/p 1 1 0 | body/h2 6 0 1 | body/p 28 0 1 | body/p 36 2 1 | body/p 41 0 1 | body/p 2 2 0 | body/p 1 1 0
body/p 5 0 0

body/article/p 2 0 1

body/article/p 70 0 1 | body/article/p 3 0 1 | body/article/p 200 3 1

body/div/a 1 1 0 | body/article/p 6 0 1 | body/article/p 30 0 1 | body/article/p 1 0 1

body/main/p 4 0 1 | body/main/p 8 0 1

body/article/p 12 4 1 | body/article/h2 3 0 1 | body/article/p 40 6 1 | body/article/p 2 0 1 | body/article/p 8 4 1 | body/article/h2 1 0 1
body/article/p 90 30 1 | body/article/p 20 2 1 | body/div/p 14 5 0 | body/div/p 60 8 0 | body/div/p 9 2 0

body/p 6 2 0 | body/p 9 3 0 | body/h1 5 0 1 | body/p 50 6 1 | body/h2 2 0 1 | body/p 70 16 1 | body/p 30 5 1 | body/p 8 3 0 | body/p 4 1 0

body/p 40 0 1

body/p 1 1 0 | body/p 1 1 0 | body/p 120 0 1 | body/p 100 2 1 | body/p 1 1 0

body/ul/li 3 3 0 | body/ul/li 4 4 0 | body/article/p 90 0 1 | body/article/p 2 2 1 | body/article/p 80 0 1

body/h1 5 0 1 | body/p 90 0 1 | body/p 60 4 1 | body/p 120 0 1 | body/p 35 0 1 | body/p 22 0 1

body/div.menu/a 3 3 0 | body/div/p 25 0 1 | body/div/p 100 2 1 | body/div/p 48 0 1

body/article/p 250 0 1 | body/article/p 3 0 1 | body/article/p 2 0 1 | body/article/p 8 0 1 | body/article/blockquote 16 0 1
body/article/p 9 4 1 | body/article/table/tr/td 1 0 1 | body/article/table/tr/td 2 0 1 | body/div.teaser/p 25 0 0 | body/div/p 3 0 0
body/div/ul/li 12 12 0 | body/div/ul/li 1 1 0 | body/div.privacy-cookie/p 30 2 0
"""


def _drawn(rows: str) -> tuple[str, list[int]]:
    """A labelled page as markup, and the labels of its blocks."""
    out, labels, open_ = [], [], []
    for row in rows.replace("\n", " | ").split(" | "):
        path, words, linked, label = row.split()
        steps = path.split("/")
        same = 0
        while same < min(len(open_), len(steps) - 1) and open_[same] == steps[same]:
            same += 1
        out += [f"</{x.split('.')[0]}>" for x in reversed(open_[same:])]
        for x in steps[same:]:
            name, _, kind = x.partition(".")
            out.append(f'<{name} class="{kind}">' if kind else f"<{name}>")
        open_ = steps
        out.append("w " * (int(words) - int(linked)) + f"<a href=x>{'w ' * int(linked)}</a>")
        labels.append(int(label))
    return "".join(out), labels


def labelled() -> np.ndarray:
    """The features of the labelled pages' blocks, and their labels."""
    rows = []
    for page in LABELLED.strip().split("\n\n"):
        markup, labels = _drawn(page)
        rows.append(np.column_stack((blocks(markup)[1], labels)))
    return np.concatenate(rows)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A classification tree by Gini impurity: a share, or (feature, cut, low, high)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            a, b = y[low], y[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return share
    _, f, cut = best
    low = x[:, f] < cut
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    """Whether each row is content."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, cut, low, high = tree
    out = np.zeros(len(x), bool)
    below = x[:, f] < cut
    out[below], out[~below] = classify(low, x[below]), classify(high, x[~below])
    return out


@functools.cache
def default_tree():
    table = labelled()
    return grow(table[:, :-1], table[:, -1])


@functools.lru_cache(1 << 14)
def _named(value: str) -> float:
    """How clearly a class, id or role names what is no article: the share of its
    words that do, the greatest of several."""
    most = 0.0
    for one in value.split():
        parts = [p for p in map(str.lower, _PARTS.findall(one)) if p not in PLAIN]
        if parts:
            most = max(most, sum(p in HINTS for p in parts) / len(parts))
    return most


def _mark(name: str, attrs: str) -> float:
    """How clearly an element says that it holds no article."""
    if name in BOILERPLATE:
        return 1.0
    if not attrs or name in ("html", "body"):
        return 0.0
    return max((_named("".join(groups)) for groups in _ATTRIBUTES.findall(attrs)), default=0.0)


class _Marks:
    """Marked elements of a page, each with the marked element around it."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.mark: list[float] = []
        self.words: list[int] = []  # unlinked words directly inside

    def add(self, parent: int, mark: float) -> int:
        self.parent.append(parent)
        self.mark.append(mark)
        self.words.append(0)
        return len(self.mark) - 1

    def chain(self, at: int) -> Iterator[int]:
        while at >= 0:
            yield at
            at = self.parent[at]

    def effective(self, articles: list[tuple[int, int]], total: int) -> list[float]:
        """The greatest mark around, without elements that enclose the page's
        article, or most of its words where it has none.

        ``articles`` has words and the marked element around of each; an article in
        marked parts counts half for each.
        """
        excused: set[int] = set()
        if articles:
            excused.update(self.chain(max(articles, key=lambda a: a[0] * 0.5 ** sum(self.mark[k] >= WHOLE_MARK for k in self.chain(a[1])))[1]))
        else:
            inside = list(self.words)
            for k in range(len(inside) - 1, -1, -1):
                if self.parent[k] >= 0:
                    inside[self.parent[k]] += inside[k]
            excused.update(k for k, n in enumerate(inside) if n >= MOST * total)
        out: list[float] = []
        for k, (parent, mark) in enumerate(zip(self.parent, self.mark)):
            out.append(max(0.0 if k in excused else mark, out[parent] if parent >= 0 else 0.0))
        return out


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """A page's text blocks in order, and their features."""
    texts: list[str] = []
    rows: list[list[float]] = []
    held: list[str] = []
    linked, in_link = 0, False
    marks = _Marks()
    # The marked element around what is read, and one that is a paragraph itself.
    top, own = -1, -1
    # Open elements: name, number of an article or -1, marked element around, and
    # the text that a marked element inside a text interrupts.
    stack: list[tuple[str, int, int, tuple | None]] = []
    inline = 0
    articles: list[list[int]] = []  # words, and the marked element around
    within: list[int] = []
    around: list[int] = []
    total = 0

    def close() -> None:
        nonlocal linked, total
        words = "".join(held).split()
        held.clear()
        if words:
            at = own if own >= 0 else top
            plain = max(0, len(words) - linked)
            texts.append(" ".join(words))
            rows.append([len(words), min(1.0, linked / len(words)), 0, 0, 0, 0, bool(within), 0, 0])
            around.append(at)
            total += plain
            if at >= 0:
                marks.words[at] += plain
            if within:
                articles[within[-1]][0] += len(words)
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            held.append(text)
            if in_link:
                linked += len(text.split())

    def leave(name: str) -> None:
        """Close the innermost element of this name, and what is open inside."""
        nonlocal top, own, linked, inline
        while True:
            was, article, before, saved = stack.pop()
            close()
            top = before
            if article >= 0:
                within.pop()
            if saved is not None:
                inline -= 1
                if saved:
                    held[:], linked, own = list(saved[0]), saved[1], saved[2]
            if was == name:
                return

    at = 0
    # Silent elements that have no end tag in the rest of the page.
    endless: set[str] = set()
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        silent = (m["silent"] or "").lower()
        if silent and not (silent in EMPTY and m["own"].endswith("/")):
            end = None if silent in endless else _ENDS[silent].search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(silent)
                at = len(page) if silent in RAW else at
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["close"]
        elif name == "br":
            held.append(" ")
        if name in VOID:
            if name in BLOCKS:
                close()
            continue
        if name not in BLOCKS:
            # Marked parts of a text are blocks of their own; the text goes on after.
            if not m["close"]:
                mark = _mark(name, m["attrs"])
                if mark >= WHOLE_MARK:
                    stack.append((name, -1, top, (list(held), linked, own)))
                    held.clear()
                    linked, inline = 0, inline + 1
                    top, own = marks.add(own if own >= 0 else top, mark), -1
                elif inline:
                    stack.append((name, -1, top, ()))
                    inline += 1
            elif inline and any(k[0] == name and k[3] is not None for k in stack):
                leave(name)
            continue
        close()
        own, in_link = -1, False
        if not m["close"]:
            mark = _mark(name, m["attrs"])
            number = marks.add(top, mark) if mark else -1
            if name not in _CONTAINERS:
                own = number
                continue
            before, article = top, -1
            top = number if mark else top
            if name in ("article", "main"):
                article = len(articles)
                articles.append([0, top])
                within.append(article)
            stack.append((name, article, before, None))
        elif name in _CONTAINERS and any(k[0] == name for k in stack):
            leave(name)
    add(page[at:])
    close()
    while stack:
        leave(stack[-1][0])
    close()
    x = np.array(rows, float).reshape(len(rows), len(FEATURES))
    if len(x):
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
        x[:, 7] = bool(articles)
        effective = marks.effective([(n, k) for n, k in articles], total)
        x[:, 8] = [effective[k] if k >= 0 else 0.0 for k in around]
    return texts, x


def main_text(page: str, tree=None) -> str:
    texts, x = blocks(page)
    if not texts:
        return ""
    keep = classify(default_tree() if tree is None else tree, x)
    return "\n".join(t for t, k in zip(texts, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every whole page.

    Null and empty pages, and pages without content, have an empty text; null ids
    and urls and repeated rows are kept; other columns are not read; an empty
    table gives an empty result.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = default_tree()
        for batch in batches:
            for part, values in slices(batch, "html", 1 << 22):
                texts = [main_text(v, tree) for v in values]
                own = batch.slice(part.start, len(values))
                yield pa.RecordBatch.from_arrays(
                    [own.column("page_id"), own.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
