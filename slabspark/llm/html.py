"""Main text of web pages, by paths that the pages of a host agree on.

Every page is read once to score its containers by the prose they hold.  The
best one votes for its path, tags and classes without their numbers.  The
path with most votes is the host's; all pages are then read again and their
text is taken from the host's path, or from the page's own best container where
the host's path holds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import materialize, table
from slabspark.llm.urls import host_and_path

#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style template noscript head title svg math iframe object canvas select textarea button form input nav header footer aside dialog menu".split())
#: Words of class, id and role that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|footer|foot|comments?|disqus|replies|reply|respond"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul br".split())
#: Elements that may hold the main text; their paths are voted on.
CONTAINERS = frozenset("article body div html main section table tbody td tr center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Shorter lines beside the main text are boilerplate if they stand in a container of their own or in the body itself.
PROSE = 25
#: A start tag of the key ends an open element of the value's kinds, up to the next container.
CLOSES = {**{t: ("p",) for t in BLOCKS - {"br"}}, "li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "tr": ("p", "tr", "td", "th"), "td": ("p", "td", "th"), "th": ("p", "td", "th")}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


@lru_cache(4096)
def _marked(names: str) -> bool:
    return bool(MARKS.search(names))


@lru_cache(4096)
def _kind(names: str) -> str:
    """The classes of a tag without their numbers, in order."""
    return ".".join(sorted({_DIGITS.sub("", c) for c in names.lower().split()} - {""}))


class _Page(HTMLParser):
    """Blocks of text with the container they stand in, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, number of the container around, hidden
        self.paths: list[str] = [""]  # of containers by number; 0 stands above all
        self.above: list[int] = [0]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self.headings: set[int] = set()  # numbers of blocks that are headings
        self.open: list[str] = []
        self.linked = 0

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def flush(self) -> None:
        if not self.open:
            return
        text = _SPACE.sub(" ", "".join(self.open)).strip()
        if text:
            if any(t in HEADINGS for t, _, _ in self.stack[-4:]):
                self.headings.add(len(self.blocks))
            self.blocks.append((self.container(), text, self.linked))
        self.open, self.linked = [], 0

    def container(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def pop_to(self, size: int) -> None:
        if any(t in BLOCKS or hidden for t, _, hidden in self.stack[size:]):
            self.flush()
        del self.stack[size:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in CLOSES.get(tag, ()):
                self.pop_to(i)
                break
            if self.stack[i][0] in CONTAINERS or self.stack[i][0] in ("ul", "ol", "dl") or self.stack[i][0] in HIDDEN:
                break
        if tag in VOID:
            return
        values = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")} if attrs else {}
        hidden = bool(self.stack and self.stack[-1][2]) or tag in HIDDEN or "hidden" in values or values.get("aria-hidden") == "true"
        hidden = hidden or bool(values) and tag not in ("html", "body", "article", "main") and _marked(" ".join(values.get(k, "") for k in ("class", "id", "role")))
        at = self.container()
        if tag in CONTAINERS:
            kind = _kind(values.get("class", ""))
            self.paths.append(f"{self.paths[at]}/{tag}" + f".{kind}" * bool(kind))
            self.above.append(at)
            at = len(self.paths) - 1
        self.stack.append((tag, at, hidden))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.flush()
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                break
            if self.stack[i][0] in CONTAINERS and tag not in CONTAINERS and tag not in HIDDEN:
                break  # a stray end tag doesn't close the container around it

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            self.open.append(data)
            if any(t == "a" for t, _, _ in self.stack[-4:]):
                self.linked += len(data)


def read(html: str | None) -> _Page:
    page = _Page()
    if html:
        page.feed(html)
        page.close()
    page.flush()
    return page


def _tag(page: _Page, at: int) -> str:
    return page.paths[at].rpartition("/")[2].split(".")[0]


def _text_beside(page: _Page, at: int, best: int, size: list[int]) -> bool:
    """Whether headings or prose of the container ``at`` stand outside its child ``best``; links and short lines are neither."""
    named = _tag(page, best) in ("article", "main")
    whole = _tag(page, at) in ("", "html", "body")
    for i, (c, text, linked) in enumerate(page.blocks):
        if not at <= c < at + size[at] or best <= c < best + size[best] or 2 * linked >= len(text):
            continue
        if c != at and named:
            continue  # an article is told from its neighbours by the page itself
        if i in page.headings or len(text) >= PROSE or c == at and not whole:
            return True
    return False


def best_container(page: _Page) -> tuple[int, float]:
    """The innermost container that holds nearly all prose, and how much that is: characters outside links, long blocks first.

    The way down ends at an article, and where a heading or prose would be left
    outside.
    """
    own = [0.0] * len(page.paths)
    held = [0] * len(page.paths)
    size = [1] * len(page.paths)
    for at, text, linked in page.blocks:
        own[at] += max(0, len(text) - 2 * linked)
        held[at] += 1
    total = own[:]
    # Containers are numbered as they open, so what is inside one follows it.
    for i in range(len(own) - 1, 0, -1):
        total[page.above[i]] += total[i]
        held[page.above[i]] += held[i]
        size[page.above[i]] += size[i]
    at = 0
    while _tag(page, at) not in ("article", "main"):
        inner = [i for i in range(at + 1, len(own)) if page.above[i] == at and total[i] > 0]
        best = max(inner, key=lambda i: (total[i], -i), default=0)
        named = _tag(page, best) in ("article", "main")
        if not best or total[best] < (0.5 if named else 0.8) * total[at] or held[best] < held[at] and _text_beside(page, at, best, size):
            break
        at = best
    return at, total[at]


def text_of(page: _Page, path: str | None) -> str:
    """The blocks inside containers of this path, or of the best container if those hold no text."""
    inside = [False] * len(page.paths)
    for i, own in enumerate(page.paths):
        inside[i] = i > 0 and (own == path or inside[page.above[i]])
    lines = [text for at, text, _ in page.blocks if inside[at]]
    if not lines:
        at, _ = best_container(page)
        inside = [i == at for i in range(len(page.paths))]
        for i in range(1, len(page.paths)):
            inside[i] = inside[i] or inside[page.above[i]]
        lines = [text for i, text, _ in page.blocks if inside[i]]
    return "\n".join(lines)


def _vote(html: pd.Series) -> pd.DataFrame:
    """The path of each page's best container, and its score."""
    rows = []
    for h in html.tolist():
        page = read(h)
        at, score = best_container(page)
        rows.append((page.paths[at] or None, score))
    return pd.DataFrame(rows, columns=["path", "score"])


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): the path most pages of each host vote for; ties to more prose, then to the smaller path."""
    host, _ = host_and_path(F.col(url_col))
    vote = F.pandas_udf(_vote, "path string, score double")
    votes = pages.select(host.alias("host"), vote(F.col(html_col)).alias("v")).select("host", "v.path", "v.score").filter("path is not null and score > 0")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("prose"))
    first = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("prose")).alias("p"), "path"))
    return counted.groupBy("host").agg(first.alias("w")).select("host", "w.path", (-F.col("w.v")).alias("votes"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null or empty html, and pages without text outside menus and the like, give
    an empty text.  Pages without a host vote together.  Repeated rows are
    read alike.
    """
    winners = materialize(winning_paths(pages, url_col, html_col), "host-paths")
    common = winners.groupBy("path").agg(F.sum("votes").alias("n")).orderBy(F.desc("n"), "path").first()
    common = common["path"] if common else None
    # Most hosts agree; only those with another path have to meet their pages.
    other = materialize(winners.filter(F.col("path") != common).select(F.col("host").alias("h"), "path"), "other-paths")
    host, _ = host_and_path(F.col(url_col))
    few = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    @F.pandas_udf("string")
    def text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, path in parts:
            yield pd.Series([text_of(read(h), p) for h, p in zip(html.tolist(), path.tolist())], dtype=object)

    out = few.join(other, F.col("host") == F.col("h"), "left").select("page_id", "url", text(F.col("html"), F.coalesce("path", F.lit(common))).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_main_text(spark, sf_dir) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
