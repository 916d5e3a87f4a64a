"""Main text of HTML pages: flat text blocks, told apart by a decision tree over word counts and link densities of a
block and its neighbours and over what its elements are for. The tree is trained on a small labelled table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import texts

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}

# Kinds of elements, and words of class and id attributes that mark boilerplate or comments.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
BOILER = frozenset("nav footer aside form menu dialog button select fieldset label".split())
BOILER_ROLES = frozenset("navigation contentinfo complementary banner search dialog alertdialog".split())
MAIN_ROLES = frozenset("main article".split())
#: Elements whose start ends an open one, each with those that it ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
SILENT = frozenset("head svg math canvas object audio video map option select button".split())
MAIN = frozenset(("article", "main"))
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookiebar cookies consent copyright disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended recommendations related rail search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
MAIN_WORDS = frozenset("article articlebody content entry main post postbody story".split())
#: Words that leave a compound name what its other words make it ("site-footer"), and elements whose names tell of a
#: layout or a topic, not of themselves.
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons container entry form global group icon icons inline inner item items left link links list main outer page panel post primary right secondary section site story text top wrap wrapper".split())
#: Whole blocks that say no more than that an advert follows.
AD_LABELS = frozenset("ad ads advertisement advertisements anzeige publicidad publicité sponsored werbung".split())
NOT_BOILER = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    words: int
    links: int  # words within links
    boiler: bool
    main: bool
    heading: bool


def _named(token: str, inside: bool) -> tuple[bool, bool]:
    """(boilerplate, maybe boilerplate) as a class or id tells: all its words must be boilerplate or neutral for the
    first, one of them for the second. A header within main text, or one of it, holds its title."""
    words = {w for w in re.split(r"[^a-z]+", token) if w}
    found = words & BOILER_WORDS
    if found == {"header"} and (inside or words & MAIN_WORDS):
        return False, False
    if words & COMMENT_WORDS and not words - COMMENT_WORDS - BOILER_WORDS - NEUTRAL_WORDS - MAIN_WORDS:
        return True, True
    return bool(found) and not words - BOILER_WORDS - NEUTRAL_WORDS, bool(found or words & COMMENT_WORDS)


def _marks(tag: str, attrs: str, inside: bool = False) -> tuple[bool, bool, bool, bool]:
    """(boilerplate, maybe boilerplate, main, silent) as an element's name and attributes tell; inside: within main."""
    boiler, weak, main, silent = tag in BOILER or tag == "header", False, tag in MAIN, tag in SILENT
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            silent = True
            continue
        if name == "role":
            boiler, main = boiler or value in BOILER_ROLES, main or value in MAIN_ROLES
        if name not in ("class", "id"):
            continue
        for token in value.split():
            sure, maybe = _named(token, inside)
            if tag in NOT_BOILER:  # an article may still be a reader's comment
                boiler |= tag == "article" and sure and bool(set(re.split(r"[^a-z]+", token)) & COMMENT_WORDS)
                continue
            # Within main text an id may be the slug of a heading.
            slug = name == "id" and inside and not set(re.split(r"[^a-z]+", token)) & COMMENT_WORDS
            boiler, weak = boiler or (sure and not slug), weak or maybe
        main |= bool(set(re.split(r"[^a-z]+", value)) & MAIN_WORDS) and tag not in ("body", "html", "a")
    return boiler, weak, main, silent


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order: runs of text between block-level tags, with white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    # Where the open elements of each name, and those of block level, stand in the stack, so that no tag walks it.
    places: dict[str, list[int]] = {}
    levels: list[int] = []
    boiler = weak = main = silent = link = 0
    parts: list[str] = []
    linked: list[str] = []
    heading = False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                links = min(n, sum(len(x.split()) for x in linked))
                # A weak mark holds where the block is mostly links; else the tree judges by words and links alone.
                out.append(Block(text, n, links, boiler > 0 or (weak > 0 and 2 * links >= n) or text.lower() in AD_LABELS, main > 0, heading))
        parts, linked = [], []

    def pop(to: int) -> None:
        nonlocal boiler, weak, main, silent, link
        while len(stack) > to:
            tag, b, k, m, s = stack[-1]
            if b and tag not in BLOCK and tag != "a":
                close()
            stack.pop()
            places[tag].pop()
            if levels and levels[-1] == len(stack):
                levels.pop()
            boiler, weak, main, silent, link = boiler - b, weak - k, main - m, silent - s, link - (tag == "a")

    def add(text: str) -> None:
        if not silent and text:
            text = entities.unescape(text)  # by run, as a reference ends where markup starts
            parts.append(text)
            if link:
                linked.append(text)

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        end, start = (m[1] or "").lower(), (m[2] or "").lower()
        if end:
            if end in BLOCK:
                close()
            at_end = places.get(end)
            # An inline end tag closes nothing outside its block.
            if at_end and (end in BLOCK or not levels or at_end[-1] > levels[-1]):
                pop(at_end[-1])
            if end in BLOCK:
                heading = False
        elif start:
            if start in BLOCK:
                close()
                if start not in ("br", "hr"):
                    heading = bool(re.fullmatch("h[1-6]", start))
                    # A paragraph, with the inline elements left open in it, ends where a block starts.
                    ends = ENDS.get(start, ())
                    while levels and ((top := stack[levels[-1]][0]) == "p" or top in ends):
                        pop(levels[-1])
            if start in _RAW:
                done = _RAW[start].search(html, at)
                at = len(html) if done is None else html.find(">", done.start()) + 1 or len(html)
                continue
            if start in VOID or (m[3] or "").endswith("/"):
                continue
            if start == "a" and link:
                pop(places["a"][-1])
            b, k, c, s = _marks(start, m[3], main > 0)
            if start == "header" and main:
                b = False  # an article's own header holds its title
            if b and start not in BLOCK and start != "a":
                close()  # boilerplate within a line is a block of its own
            places.setdefault(start, []).append(len(stack))
            if start in BLOCK:
                levels.append(len(stack))
            stack.append((start, b, k, c, s))
            boiler, weak, main, silent, link = boiler + b, weak + k, main + c, silent + s, link + (start == "a")
    close()
    return out


#: Columns of the tree's input.
FEATURES = ("boilerplate", "main", "page_has_main", "heading", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after")


def features(bs: list[Block]) -> np.ndarray:
    has = any(b.main for b in bs)
    own = [(b.words, b.links / b.words) for b in bs]
    pad = [(0, 0.0), *own, (0, 0.0)]
    return np.array([[b.boiler, b.main, has, b.heading, *pad[i + 1], *pad[i], *pad[i + 2]] for i, b in enumerate(bs)], float).reshape(-1, len(FEATURES))


# The labelled table. Each line is a page; `+` or `-` before a block's text tells whether it is main text,
# and a number stands for so many words.
LABELLED = """
<body><nav><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></nav><div class=ad>-9</div><article><h1>+8</h1><p>+10<p>+60<p>+1<p>+120<p>+3<p>+14 <a>2</a></p></article><footer>-8</footer>
<body><header>-3</header><main><h1>+5</h1><div class=share><a>-2</a></div><p>+40<p>+300<ul><li>+4<li>+9<li>+1</ul><p><a>+5</a><p>+30</main><aside><h3>-2</h3><p>-45</aside><footer><p>-30</footer>
<body><p>-7</p><article><p>+9</article><p>-30<p>-80<p>-1
<body><p>-1<p>-25<article><h2>+1</h2><p>+2<p>+1</article><h3>-2</h3><p><a>-6</a>
<body><div class=cookie-notice><p>-25</div><article><header><h1>+6</h1></header><p>+35 <a>20</a><p>+200<div id=comments><h2>-2</h2><p>-60<p>-12</div></article><form>-4</form>
<body><nav><a>-1</a></nav><div>+40</div><div>+90</div><div><a>-1</a> <a>1</a> <a>1</a></div>
<body><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul><h1>+6</h1><p>+22<p>+3<p>+50<p>+6<ul><li><a>-3</a><li><a>-4</a></ul><p><a>-2</a>
<body><h1>+1</h1><p>+20<p>+2
<body><p>+4
<body>+3
<body><h1>+2</h1>
<body><h2>+3</h2><p>+60 <a>4</a><h2>+2</h2><p>+12 <a>3</a><p>+1
<body><table><tr><td><a>-1</a><td><a>-2</a><td><a>-1</a></table><table><tr><td>+120<tr><td>+5<tr><td>+70 <a>15</a></table><div><a>-3</a> - <a>3</a></div>
<body><div><a>-1</a> <a>1</a> <a>2</a> <a>1</a></div><h1>+4</h1><div>+15</div><div>+8 <a>1</a></div><div>+33</div><div>2 <a>-9</a> <a>8</a></div><footer>-50</footer>
<body><div class=sidebar><p>-120<p>-3</div><p>+18<p>+5<p>+9<div class=newsletter><p>-20<p>-40</div>
<body><p><a>-2</a><p>+2<p>+3<p>+1<p>+7<p>1 <a>-8</a>
<body><div><p><a>-4</a><p><a>-7</a><p><a>-5</a></div><p>+10<p>+26 <a>6</a><p>+4
<body><header><h1>-2</h1><p>-9</header><h1>+7</h1><p>+80<p>+1<div class=ads>-70</div><p>+44<form><p>-6<p>-15</form>
"""


def labelled_pages(table: str = LABELLED) -> list[tuple[str, list[bool]]]:
    """The table's pages as HTML, and whether each block is main text."""
    return [(re.sub(r"(?<=[\s>])([+-]?)(\d+)|(^-)", lambda m: " ".join(["word"] * int(m[2] or 0)), row), [m == "+" for m in re.findall(r"([+-])\d", row)]) for row in table.strip().splitlines()]


class Tree:
    """A binary decision tree grown by the Gini index until its leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.value, self.column = float(y.mean()) >= 0.5, -1
        if depth == 0 or y.min() == y.max():
            return
        best = None
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, c] < cut
                gini = sum(part.sum() * (1 - part.mean()) for part in (y[low], y[~low]))
                if best is None or gini < best[0] - 1e-9:
                    best = gini, c, cut
        if best is None:
            return
        _, self.column, self.cut = best
        low = x[:, self.column] < self.cut
        self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.value)
        low = x[:, self.column] < self.cut
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def train_tree(table: str = LABELLED) -> Tree:
    pages = labelled_pages(table)
    return Tree(np.concatenate([features(blocks(html)) for html, _ in pages]), np.concatenate([np.array(y, float) for _, y in pages]))


def main_text(html: str | None, tree: Tree) -> str:
    bs = blocks(html) if html else []
    return " ".join(b.text for b, keep in zip(bs, tree.predict(features(bs)), strict=True) if keep) if bs else ""


def extract_main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """pages' columns `keep` (default: page_id, url), text and n_chars. Null and empty pages, and pages of which no
    block is main text, have the text "". Pages are read whole. Repeated rows each give a row; an empty table gives an
    empty result."""
    keep = keep or ["page_id", "url"]
    tree = train_tree()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(t.decode("utf-8", "replace") if t else None, tree) for t in texts(b, "__html")]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*keep, "__text", "__n"])

    frame = pages.select(*keep, F.col("html").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[: len(keep)])
    return frame.mapInArrow(extract, f"{schema}, __text string, __n long").withColumnsRenamed({"__text": "text", "__n": "n_chars"})
