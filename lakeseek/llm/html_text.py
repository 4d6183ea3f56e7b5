"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of items: runs of words, and tags. Words score above
zero and tags below; the subsequence of items that scores most, found in one linear
scan, is the content region. It is widened to whole blocks, and what stands
in page furniture inside of it (menus, adverts, comments and the like) is left out.

Weights come from labelled pages: those that mark their article with an article element. Items of
all labelled pages are counted by class, inside and outside of the article; a weight is
the logarithm of the ratio of the two shares, held above zero for words and below for tags. A class
says what tag it is and what stands beside it, or in which block words stand and whether in a
link, and whether this is in page furniture (see below); links that no labelled page has outside of furniture weigh as those inside. Classes are made of known tag names only, so the counts that come to the driver
are bounded; counting and extraction are two scans, and pages never move. Weights are integers, so that
sums are exact. Pages without an article element are read by the same weights.

Details: script, style and other hidden elements and comments vanish. Furniture is an element
whose name says so, or whose role, or the first or last part of a class or id, is in
FURNITURE; an article in an article is a comment; a header or footer in an article isn't the page's, but
footers go all the same. Furniture without an end tag reaches to the next block only. A br is white space; other tags
inside a block are nothing. White space is what Unicode calls so, character references are HTML 5's.

Defined results: a null or empty page, or one without words, has an empty text; every row comes back
once, also repeated ones and those without page_id or url. Extra columns are ignored. Without labelled
pages, weights are the defaults: 1 for words, and for tags -0.5. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import ship

#: Element names of HTML: fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big br button cite code em font i img input kbd label mark q s samp select small span strong sub sup tt u var".split())
HIDDEN = "script|style|noscript|template|iframe|object|svg|math|textarea|select|noframes|noembed|xmp|title"
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button search head".split())
#: Words that mark page furniture as a role, or at either end of a class or id: fixed values.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs"
    " masthead header footer comment comments disqus replies respond related recommended share sharing social toolbar pagination pager search complementary"
    " contentinfo form alert toc skip".split()
)
#: A class that starts so says what the page has, not what the element is.
_SAYS = frozenset("has with no without".split())
#: Elements that a class about furniture doesn't make furniture.
_FRAME = frozenset("html body main article".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<hidden>{HIDDEN})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=hidden)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-z][^>]*+>"
    r"|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
_MARK = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
UNIT, LEAST, MOST_WORD, MOST_TAG, NEW_WORD, NEW_TAG = 1000, 20, 1000, 6000, 1000, 500


class Item(NamedTuple):
    """A run of text (with its number of words) or a tag; block: number of the block that it stands in."""

    kind: str
    is_text: bool
    text: str | None
    words: int
    block: int
    furniture: bool
    article: bool


def _marks_furniture(name: str, attributes: str) -> bool:
    if name in _FRAME:
        return False
    for what, *values in _MARK.findall(attributes):
        value = "".join(values)
        if what.lower() == "hidden":
            return True
        for label in value.split():
            parts = [p.lower() for p in _PART.findall(label)]
            if parts and parts[0] not in _SAYS and (parts[0] in FURNITURE or parts[-1] in FURNITURE):
                return True
    return False


def _spans(tags: list[tuple[int, str, bool, str]], size: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Token ranges that are furniture, and those of outer articles. tags: (token, name, is an end tag, attributes)."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for at, (_, name, is_end, _) in enumerate(tags):
        if not is_end:
            open_.setdefault(name, []).append(at)
        elif open_.get(name):
            ends[open_[name].pop()] = at
    blocks = [token for token, name, _, _ in tags if name in BLOCKS]
    furniture, articles, inside, following = [], [], -1, 0
    for at, (token, name, is_end, attributes) in enumerate(tags):
        if is_end:
            continue
        while following < len(blocks) and blocks[following] <= token:
            following += 1
        close = tags[ends[at]][0] if at in ends else None
        own = name in FURNITURE_TAGS and not (name == "header" and token < inside)
        if own or (name == "article" and token < inside) or (attributes and not (name != "footer" and token < inside and _is_head(attributes)) and _marks_furniture(name, attributes)):
            until = close if close is not None else blocks[following] - 1 if following < len(blocks) else size - 1
            furniture.append((token, until))
        elif name == "article" and close is not None:
            articles.append((token, close))
            inside = close
    return furniture, articles


def _is_head(attributes: str) -> bool:
    """Whether classes name a header: inside an article it is the article's own."""
    return all("header" in value.lower() or not value for what, *values in _MARK.findall(attributes) for value in ["".join(values)])


def items(page: str) -> list[Item]:
    """The page's items in order."""
    tokens = list(_TOKEN.finditer(page))
    tags = [(at, m["name"].lower(), bool(m["end"]), m["attributes"]) for at, m in enumerate(tokens) if m["name"]]
    furniture, articles = _spans(tags, len(tokens))
    marks = [[False] * len(tokens), [False] * len(tokens)]
    for ranges, mark in zip((furniture, articles), marks, strict=True):
        reached = -1
        for a, b in sorted(ranges):
            for at in range(max(a, reached + 1), b + 1):
                mark[at] = True
            reached = max(reached, b)
    out, block, where, link = [], 0, "", 0
    # What stands beside a tag: the kind of the item before an end tag, after a start tag.
    plain = [("w" if (m["text"] or "").strip() else "") if m["text"] is not None else (("/" if m["end"] else "") + _known(m["name"].lower())) if m["name"] else "" for m in tokens]
    beside = [p for p in plain if p]
    seen = 0
    for at, m in enumerate(tokens):
        seen += bool(plain[at])
        if m["text"] is not None:
            text = html.unescape(m["text"])
            words = len(text.split())
            own = "~" if marks[0][at] else ""
            out.append(Item(f"{own}w {where}{' a' if link > 0 else ''}", True, text, words, block, marks[0][at], marks[1][at]))
        elif m["name"]:
            name = m["name"].lower()
            near = (beside[seen - 2] if seen > 1 else "") if m["end"] else (beside[seen] if seen < len(beside) else "")
            if name in BLOCKS:
                block += 1
                where = ("/" if m["end"] else "") + _known(name)
            elif name == "a":
                link = 0 if m["end"] else 1
            out.append(Item(f"{'~' if marks[0][at] else ''}{plain[at]} {near}", False, " " if name == "br" else None, 0, block, marks[0][at], marks[1][at] and name != "article"))
    return out


def weight(kind: str, weights: dict[str, int]) -> int:
    """The weight of a class, of the same in furniture for links that have none, else the default."""
    if kind in weights:
        return weights[kind]
    default = NEW_WORD if kind.startswith("w ") else -NEW_TAG
    return weights.get("~" + kind, default) if {"a", "/a"} & set(kind.split()) else default


def _known(name: str) -> str:
    return name if name in BLOCKS or name in INLINE else "other"


def region(page: list[Item], weights: dict[str, int]) -> tuple[int, int]:
    """First and last item of the contiguous part that scores most, widened to whole blocks; the first of equals; (0, -1) without words."""
    best, found, total, start = 0, (0, -1), 0, 0
    for at, item in enumerate(page):
        if item.words:
            total += 0 if item.furniture else item.words * weight(item.kind, weights)
        elif not item.is_text:
            # Furniture is one item, whatever it is made of: it isn't text, but it doesn't part the text around it either.
            total += weight(item.kind, weights) if not item.furniture else -UNIT if at == 0 or not page[at - 1].furniture else 0
        if total <= 0:
            total, start = 0, at + 1
        elif total > best:
            best, found = total, (start, at)
    first, last = found
    while first <= last and first > 0 and page[first - 1].block == page[first].block:
        first -= 1
    while last >= first and last + 1 < len(page) and page[last + 1].block == page[last].block:
        last += 1
    return first, last


def main_text(page: str | None, weights: dict[str, int]) -> str:
    parts = items(page or "")
    first, last = region(parts, weights)
    blocks: dict[int, list[str]] = {}
    for item in parts[first : last + 1]:
        if item.text is not None and not item.furniture:
            blocks.setdefault(item.block, []).append(item.text)
    return "\n".join(text for pieces in blocks.values() if (text := " ".join("".join(pieces).split())))


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of items in a task's labelled pages, how many stand inside and outside of the article; words count one by one."""
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column("html"):
            if (text := page.as_py()) and "<article" in text.lower():
                read = items(text)
                if any(i.article for i in read):
                    for i in read:
                        if i.words or not i.is_text:
                            (inside if i.article and not i.furniture else outside)[i.kind] += max(i.words, 1)
    kinds = sorted(inside | outside)
    yield pa.record_batch([pa.array(kinds, pa.string()), *(pa.array([c[k] for k in kinds], pa.int64()) for c in (inside, outside))], ["kind", "inside", "outside"])


def fit(pages: DataFrame) -> dict[str, int]:
    """Weights by class of items, from all labelled pages."""
    counts = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(_label, "kind string, inside long, outside long")
    rows = counts.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    all_in, all_out = (sum(r[c] for r in rows) + len(rows) for c in ("inside", "outside"))
    weights = {}
    for r in rows:
        w = round(UNIT * (log((r.inside + 1) / all_in) - log((r.outside + 1) / all_out)))
        weights[r.kind] = min(max(w, LEAST), MOST_WORD) if r.kind.lstrip("~").startswith("w ") else max(min(w, -LEAST), -MOST_TAG)
    return weights


def _extract(weights: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py(), weights) for page in batch.column("html")], pa.string())
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages(page_id, url, html); weights are fitted to these pages if not given."""
    ship(pages.sparkSession)
    weights = fit(pages) if weights is None else weights
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(_extract(weights), "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
