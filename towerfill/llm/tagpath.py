"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each under its root-to-leaf path of block elements.
Elements that are no part of an article by their name are left out with all they hold
(of a header inside an article its headings stay). Text length and punctuation are summed per path;
a path's ratios (characters and punctuation marks for each of its blocks, without
link text) are smoothed over the page with a Gaussian, fused, and compared with a
threshold. Paths above it give the content nodes; what the smallest element around
all of them holds is the article, so that its headings and short paragraphs stay.

Classes, ids and roles are evidence that the scores weigh. An element whose whole class
name marks it (or a part of it does, for comments and cookie notices) goes, unless the
article would go with it: then the marked element with the highest score stays, and
what is marked inside it is judged anew. Articles marked so, as comments often are, are
no article. An element of which only a part of a class name is a mark goes if the ratios of
its own blocks are less than half of what unmarked paths score on average.

Defined results: null or textless pages give an empty text. Repeated rows each get
a row. Columns other than id, url and html are not read. An empty table gives no
rows. A page is read whole, however long, and paths of equal scores get one
verdict. Unclosed and stray tags are taken as browsers take them; an unclosed comment,
script or style runs to the end.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.llm.common import table

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SCRIPT = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|$)", re.S | re.I)
SECTION = re.compile(r"<(?:article|main)[\s>]", re.I)
SPACE = re.compile(r"\s+")

#: Elements whose inside is not text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Elements that never belong to an article's text.
OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "datalist", "dialog", "menu", "head", "template",
           "svg", "canvas", "object", "audio", "video", "map", "fieldset", "legend"}
#: Whole class names, ids or roles that mark such a part.
MARKS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "foot", "sidebar",
         "aside", "complementary", "contentinfo", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored",
         "promo", "promotion", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter",
         "subscribe", "subscription", "signup", "login", "search", "social", "share", "sharing", "related", "recommended", "comment",
         "comments", "disqus", "reply", "replies", "respond", "pagination", "pager", "toolbar", "widget", "hidden", "skip", "copyright"}
#: Of these also a part of a class name is enough.
STRONG_PARTS = {"comment", "comments", "disqus", "replies", "respond", "cookie", "cookies", "consent"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An end tag or a sibling's start closes these; a block's start closes an open paragraph.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "p": {"p"}}
SECTIONS = {"article", "main"}
PUNCTUATION = re.compile(r"[.,;:!?。，；？！…]")


@dataclass
class Block:
    """A run of text between block boundaries: its path, its element chain and what of it is link text."""

    path: str
    chain: tuple[int, ...]
    text: str
    link: int


WEAK, STRONG = 1, 2


def outside(name: str, tag: str) -> tuple[bool, int]:
    """Whether an element is no part of an article by its name or because it is hidden, and how strongly its class, id or role says so."""
    if name in OUTSIDE:
        return True, 0
    marked = 0
    for m in ATTRIBUTE.finditer(tag, len(name) + 1):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True, 0
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, 0
        elif name not in ("html", "body", "main"):
            parts = set(re.split(r"[\s_-]+", value))
            if not MARKS.isdisjoint(value.split()) or not STRONG_PARTS.isdisjoint(parts):
                marked = STRONG
            elif name != "article" and not MARKS.isdisjoint(parts):
                marked = max(marked, WEAK)
    return False, marked


def text_size(page: str) -> int:
    return len(MARKUP.sub("", SCRIPT.sub("", page)))


def blocks(page: str) -> tuple[list[Block], dict[int, str], bool]:
    """The text blocks inside no left-out element, the names of their elements, and whether an article or main element has text."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # name, number, left out
    names: dict[int, str] = {}
    marked: dict[int, int] = {}
    heads: set[int] = set()  # headers inside a section
    text: list[str] = []
    link, links, number, at, size = 0, 0, 0, 0, -1

    def main_part(part: str) -> bool:
        nonlocal size
        size = text_size(page) if size < 0 else size
        return SECTION.search(part) is not None or 2 * len(part) > size and 2 * text_size(part) > size

    def flush():
        nonlocal text, link
        if text:
            whole = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if whole and not any(x[2] for x in stack):
                out.append(Block("/".join(x[0] for x in stack), tuple(x[1] for x in stack), whole, min(link, len(whole))))
            text, link = [], 0

    while at < len(page):
        m = MARKUP.search(page, at)
        piece = page[at:m.start() if m else len(page)]
        if piece:
            text.append(piece)
            link += len(piece) if links else 0
        if not m:
            break
        at, tag = m.end(), m.group()
        t = TAG.match(tag)
        if not t:
            continue
        close, name = t[1], t[2].lower()
        if name in RAW and not close:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a":
            links = 0 if close else 1
            continue
        if name in INLINE:
            gone, mark = (False, 0) if close else outside(name, tag)
            if gone or mark == STRONG:  # a marked inline part is dropped up to its end
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end and (gone or not main_part(page[at:end.start()])):
                    at = end.end()
            continue
        if name == "br":
            text.append(" ")
            continue
        flush()
        if name in VOID or tag.endswith("/>") and name not in SECTIONS and name not in ("div", "p", "section"):
            continue
        if close:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
                links = 0
            continue
        if stack and stack[-1][0] == "p" or stack and name in CLOSED_BY and stack[-1][0] in CLOSED_BY[name]:
            stack.pop()
        elif name in ("li", "tr", "dt", "dd", "td", "th"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSED_BY[name]:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                    break
        number += 1
        names[number] = name
        gone, mark = outside(name, tag)
        if name == "header" and any(x[0] in SECTIONS for x in stack):
            gone = False
            heads.add(number)
        stack.append((name, number, gone))
        if mark:
            marked[number] = mark
    flush()
    out = [b for b in out if heads.isdisjoint(b.chain) or not HEADINGS.isdisjoint(names[i] for i in b.chain)]
    articles = {i for i, n in names.items() if n in SECTIONS and marked.get(i) != STRONG}
    out = _unmarked(out, marked, articles, names)
    return out, names, any(i in articles for b in out for i in b.chain)


def _unmarked(out: list[Block], marked: dict[int, int], articles: set[int], names: dict[int, str]) -> list[Block]:
    """The blocks that marks and path scores leave."""
    if not out or not marked:
        return out
    score = path_scores(out)
    against = {i for i, m in marked.items() if m == STRONG}
    in_article = np.array([not articles.isdisjoint(b.chain) for b in out])
    while against:
        free = np.array([against.isdisjoint(b.chain) for b in out])
        if (free & in_article).any() if in_article.any() else 2 * score[free].sum() >= score.sum():
            break
        sums: dict[int, float] = {}  # of the outermost marked elements; with articles only of those that hold one
        for b, s, a in zip(out, score, in_article):
            if (a or not in_article.any()) and (i := next((i for i in b.chain if i in against), None)) is not None:
                sums[i] = sums.get(i, 0.0) + s
        best = max(sums, key=sums.get, default=None)
        if best is None or not in_article.any() and 2 * sums[best] <= score.sum():
            break
        against.discard(best)
    left = [k for k, b in enumerate(out) if against.isdisjoint(b.chain)]
    weak = {i for i, m in marked.items() if m == WEAK}
    plain = [score[k] for k in left if weak.isdisjoint(out[k].chain)]
    usual = np.mean(plain) if plain else 0.0
    below: dict[int, list[float]] = {}  # by element, as paths know no classes
    for k in left:
        for i in weak.intersection(out[k].chain):
            below.setdefault(i, []).append(float(np.prod(ratio(out[k]))))
    holders = {i for k in left if in_article[k] for i in out[k].chain[:next(n for n, j in enumerate(out[k].chain) if j in articles)]}
    poor = {i for i, s in below.items() if i not in holders and 2 * np.mean(s) < usual}
    return [out[k] for k in left if poor.isdisjoint(out[k].chain) or in_article[k] and any(names[i] == "h1" for i in out[k].chain)]


def ratio(b: Block) -> tuple[float, float]:
    """Characters, and punctuation marks plus one, of a block without its link text."""
    return len(b.text) - b.link, len(PUNCTUATION.findall(b.text)) * (1 - b.link / len(b.text)) + 1


def path_scores(found: list[Block], sigma: float = 1.0) -> np.ndarray:
    """The fused, smoothed tag-path ratio of each block.

    Length and punctuation are summed by path and divided by the path's blocks;
    link text counts for nothing. Each ratio is smoothed over the page's blocks,
    and the two are multiplied (punctuation plus one, so that none does not erase).
    """
    sums: dict[str, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        chars, marks = ratio(b)
        s[0] += chars
        s[1] += marks
        s[2] += 1
    ratios = np.array([[sums[b.path][0] / sums[b.path][2], sums[b.path][1] / sums[b.path][2]] for b in found])
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma ** 2))
    kernel /= kernel.sum()
    padded = np.pad(ratios, ((reach, reach), (0, 0)), mode="edge")
    smooth = np.stack([np.convolve(padded[:, j], kernel, mode="valid") for j in range(2)], axis=1)
    return smooth[:, 0] * smooth[:, 1]


def main_text(page: str | None, share: float = 0.5) -> str:
    """The article's blocks joined by line breaks.

    A block is content if its score is at least ``share`` of the standard deviation
    of all scores, or the page's scores do not differ. With article or main
    elements only blocks in them can be content; a block of nothing but links in
    them stays out, but for headings. Without, the article is the nearest element that holds all content
    blocks and more than the text of one element; the same blocks in it stay.
    """
    found, names, sectioned = blocks(page or "")
    if sectioned:
        found = [b for b in found if any(names[i] in SECTIONS for i in b.chain)]
    if not found:
        return ""
    score = path_scores(found)
    chosen = score >= share * score.std()
    if not chosen.any():
        chosen[:] = True
    picked = [b for b, c in zip(found, chosen) if c]
    if sectioned:
        hosts = {next(i for i in b.chain if names[i] in SECTIONS) for b in picked}
    else:
        hosts = host(found, picked)
    inside = [b for b, c in zip(found, chosen) if (not hosts or not hosts.isdisjoint(b.chain))
              and (b.link < len(b.text) or c or not HEADINGS.isdisjoint(names[i] for i in b.chain))]
    return "\n".join(b.text for b in inside)


def host(found: list[Block], picked: list[Block]) -> set[int]:
    """The deepest element that holds all picked blocks and blocks of more than one element; none if only the page does."""
    shared = picked[0].chain
    for b in picked:
        n = next((k for k, (x, y) in enumerate(zip(shared, b.chain)) if x != y), min(len(shared), len(b.chain)))
        shared = shared[:n]
    held: dict[int, tuple[int, ...]] = {}
    wide: set[int] = set()
    for b in found:
        for i in b.chain:
            if held.setdefault(i, b.chain) != b.chain:
                wide.add(i)
    return {next((i for i in reversed(shared) if i in wide), 0)} - {0}


def _extract(batches):
    for b in batches:
        texts = [main_text(x) for x in b["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and ``n_chars``."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
