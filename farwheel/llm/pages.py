"""HTML extraction by consensus host paths.

Every page scores its containers: a block of text gives its characters outside links to the container that holds it, half
of them to the next one out, and so on. A container whose parent belongs to the same article votes for the parent: an
`article` or `main` always does, another one if the container holds at least half of its text and what else it holds is
text rather than links. So headings, leads and sections beside the longest part stay. A path is a container's chain of
tags and classes with digits generalised. Each page hands its score, as shares that sum to 1, to its paths; Spark sums the
shares per host and path, and the path with most is the host's. Then every page is extracted anew from the containers on
its host's path; a page without one falls back to its own best container.

Dropped wherever they stand: the elements and roles listed below, and what a class or id names by a whole word or by a compound
of such words ("ad-slot", "site-header"). Outside an article a plain word such as "sidebar" drops any compound; within one a
compound with any other word ("share-price", "cookie-recipe", "menu-of-the-day") drops nothing, nor do a header, a paragraph or heading
by a word that articles use too ("alert"), or an id by such a word. An article named as a reader's goes, but not one that is
a post as well, unless it stands in another. Formulas stay in their sentence, their sources go. Blocks are what block elements part;
`br` is white space. A column `text` of the input is replaced. A null html, or one without text, gives an empty text; a null url is host ''; ties go to the first
path by name; repeated rows get equal texts; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farwheel.llm.shared import prepare, written

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "fieldset", "svg", "object", "annotation", "annotation-xml", "canvas", "dialog", "menu", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A formula's elements, inline too.
INLINE |= {"math", "semantics", "annotation", "annotation-xml", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mpadded", "mfenced", "menclose", "mphantom", "mmultiscripts"}
#: An article, by an element's own class.
HOMES = {"article", "post", "story", "entry"}
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center", "blockquote"}
#: Words of a class or id by which a part is not the article's, alone and in any compound.
STRONG = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "sponsored", "promo", "promoted", "cookie", "cookies", "consent", "gdpr",
    "popup", "modal", "newsletter", "subscribe", "paywall", "sidebar", "sidebars", "widget", "widgets", "menu", "menus", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer", "comments", "commentlist", "disqus", "pagination", "pager", "toolbar",
}
#: Words that count alone, and in a compound of words from here or from PLACES.
SIGNS = STRONG | {
    "sponsor", "banner", "notice", "notices", "alert", "overlay", "rail", "toc", "header", "foot", "copyright", "comment", "replies", "reply", "respond",
    "share", "sharing", "social", "related", "recommended", "login", "signup", "search", "skip",
}
#: Words that articles use too: within one they drop neither paragraphs nor headings, nor anything by an id.
DOUBTFUL = {"alert", "overlay", "rail", "toc", "foot", "share", "sharing", "social", "related", "recommended", "login", "signup", "search", "skip"}
#: An article with one of these is a reader's.
COMMENTS = {"comment", "comments", "reply", "replies"}
PLACES = {
    "site", "page", "global", "top", "bottom", "left", "right", "main", "buttons", "button", "bar", "links", "link", "icons", "tools", "box", "form", "list", "posts", "articles",
    "stories", "news", "block", "section", "area", "wrapper", "wrap", "container", "slot", "unit", "inner", "content", "media", "js", "user", "reader", "item",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
#: An opening tag ends an open element of these names, up to the nearest of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^a-z0-9]+")


class Block(NamedTuple):
    text: str
    chain: tuple[int, ...]  # the containers that hold it, outermost first
    own: int  # characters outside links


class Page(NamedTuple):
    blocks: list[Block]
    paths: list[str]  # of each container
    tags: list[str]
    parents: list[int]  # -1: none

    def scores(self) -> list[float]:
        out = [0.0] * len(self.paths)
        for b in self.blocks:
            share = float(b.own)
            for k in reversed(b.chain):
                out[k] += share
                share /= 2
        return out

    def homes(self) -> list[int]:
        """The container that each one votes for."""
        own, size = [0] * len(self.paths), [0] * len(self.paths)
        for b in self.blocks:
            for k in b.chain:
                own[k] += b.own
                size[k] += len(b.text)
        out = list(range(len(self.paths)))
        for k, p in enumerate(self.parents):  # parents stand before their children
            if p >= 0 and self.tags[p] not in ("html", "body"):
                mostly = 2 * own[k] >= own[p] and 10 * (own[p] - own[k]) >= 7 * (size[p] - size[k])
                if self.tags[p] in ("article", "main") or mostly:
                    out[k] = out[p]
        return out

    def shares(self) -> dict[str, float]:
        by: dict[str, float] = {}
        scores = self.scores()
        total = sum(scores)
        for home, x in zip(self.homes(), scores, strict=True):
            if x > 0:
                by[self.paths[home]] = by.get(self.paths[home], 0.0) + x / total
        return by

    def text(self, path: str | None) -> str:
        """The blocks under the containers on this path, or else under the page's best path."""
        chosen = {k for k, p in enumerate(self.paths) if p == path}
        found = [b.text for b in self.blocks if chosen.intersection(b.chain)] if chosen else []
        if not found and self.blocks:
            by = self.shares()
            best = min(by, key=lambda p: (-by[p], p)) if by else None
            chosen = {k for k, p in enumerate(self.paths) if p == best}
            found = [b.text for b in self.blocks if not by or chosen.intersection(b.chain)]
        return "\n".join(found)


class _Open(NamedTuple):
    tag: str
    dropped: bool
    chain: tuple[int, ...]
    path: str
    link: bool
    inside: bool = False  # an article


def parse(source: str) -> Page:
    blocks: list[Block] = []
    paths: list[str] = []
    tags: list[str] = []
    parents: list[int] = []
    stack = [_Open("", False, (), "", False)]
    words: list[str] = []
    own = 0

    def flush() -> None:
        nonlocal own
        text = " ".join("".join(words).split())
        if text:
            blocks.append(Block(text, stack[-1].chain, own))
        words.clear()
        own = 0

    def close(names: set[str], bounds: set[str], part: bool = True) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                if part:  # an inline element's end parts no block
                    flush()
                del stack[i:]
                return
            if stack[i].tag in bounds:
                return

    pos, end = 0, len(source)
    while pos < end:
        m = _TOKEN.match(source, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            top, raw = stack[-1], m[0]
            if top.dropped or (raw[0] == "<" and len(raw) > 1):
                continue
            text = html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if not top.link:
                own += len(text)
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in INLINE:
                close({tag}, {x.tag for x in stack} - INLINE, part=False)
                continue
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}\s*>", re.I).search(source, pos)
            pos = over.end() if over else end
            continue
        if tag not in INLINE:
            flush()
            if tag not in VOID:
                close({"p"}, CONTAINERS | {"table", "ul", "ol"})
            if tag in ENDS:
                close(*ENDS[tag])
        if tag in VOID:
            continue
        top = stack[-1]
        named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs else {}
        dropped = top.dropped or tag in DROPPED or (tag == "header" and not ({"article", "main"} & {x.tag for x in stack}))
        inside = top.inside or tag in ("article", "main")
        if tag == "article":
            names = set(_WORDS.split(named.get("class", "")))
            dropped = dropped or (not COMMENTS.isdisjoint(names) and ("article" in {x.tag for x in stack} or HOMES.isdisjoint(names)))
        elif not dropped and named and tag not in ("html", "body", "main"):
            dropped = named.get("role") in ROLES or is_part(named, top.inside, tag)
            inside = inside or not HOMES.isdisjoint(named.get("class", "").split())
        chain, path = top.chain, top.path
        if tag not in INLINE:
            path += ">" + ".".join([tag, *sorted(_DIGITS.sub("#", named.get("class", "")).split())])
            if tag in CONTAINERS and not dropped:
                parents.append(chain[-1] if chain else -1)
                chain = (*chain, len(paths))
                paths.append(path)
                tags.append(tag)
        if dropped and not top.dropped and tag not in INLINE:
            flush()
        stack.append(_Open(tag, dropped, chain, path, top.link or tag == "a", inside))
    flush()
    return Page(blocks, paths, tags, parents)


def is_sign(word: str, in_article: bool) -> bool:
    """Whether a word of a class or id, perhaps a compound, names a part that is not the article's."""
    parts = [p for p in _WORDS.split(word) if p]
    if in_article and "header" in parts:
        return False
    if not in_article and not STRONG.isdisjoint(parts):
        return True
    return not SIGNS.isdisjoint(parts) and all(p in SIGNS or p in PLACES or p.isdigit() for p in parts)


def is_part(named: dict[str, str], in_article: bool, tag: str) -> bool:
    """Whether an element's class or id says that it is not the article's."""
    if any(is_sign(w, in_article) and not (in_article and tag in TEXTUAL and w in DOUBTFUL) for w in named.get("class", "").split()):
        return True
    return any(is_sign(w, in_article) and not (in_article and w in DOUBTFUL) for w in named.get("id", "").split())


def host_of(url: Column) -> Column:
    """The host of a url in lower case, '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the largest sum of shares on each host, of (url, html)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, x in parse(source).shares().items() if source else ():
                    sums[host, path] = sums.get((host, path), 0.0) + x
            cols = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["host", "path", "votes"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, votes double")
    # rounded, since the order of a sum of doubles is open
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return sums.groupBy("host").agg(F.min(F.struct(-F.col("votes"), "path")).alias("best")).select("host", "best.path")


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with `html` replaced by `text`, the main text."""
    prepare(pages.sparkSession)
    paths = written(host_paths(pages), "host-paths")  # its size is known then: Spark broadcasts it only while small
    rows = pages.drop("text").withColumn("__host", host_of(F.col("url")))
    joined = rows.join(paths.select(F.col("host").alias("__host"), F.col("path").alias("__path")), "__host", "left").drop("__host")
    at, path_at = joined.columns.index("html"), joined.columns.index("__path")
    keep = [i for i in range(len(joined.columns)) if i not in (at, path_at)]
    schema = T.StructType([joined.schema.fields[i] for i in keep]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [parse(h).text(p) if h else "" for h, p in zip(b.column(at).to_pylist(), b.column(path_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(texts, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)
