"""The main text of web pages, by ratios of text and punctuation per tag path.

A page is read once into blocks of text, each with its root-to-leaf path of
block elements.  Per path the text length and the punctuation per block are
averaged, smoothed along the page, fused into one score and compared with a
share of the page's typical score; the blocks of the paths that pass are the
content.  What the page itself declares is a prior that multiplies a path's
score: links lower it, so does each element around it with a whole class, id or
role of furniture, unless that holds an article, and so do bare containers in
place of paragraphs and items.  Text in ``article`` or ``main`` gains, and text
beside it loses, the more of the page's text stands there; a small teaser loses.
Only elements that are never content by their name are left out unread.
Headings belong to the content that they stand in or stand before.

Each page is worked on alone in Arrow batches, in time linear in its length.
Defined cases: null or empty html gives an empty text; broken markup is read as
browsers do in the common cases (unclosed paragraphs and items, stray ends);
rows are independent; an empty table gives an empty table; further columns stay
out of the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img label input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
NEVER = frozenset(
    "head nav aside footer form button select option textarea noscript template iframe object svg canvas dialog menu "
    "audio video script style title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body", "article", "main"))
CLOSES_ITS_OWN = frozenset("li dt dd tr td th option".split())
PROSE = frozenset("p li dt dd td th caption figcaption blockquote pre".split())
HOLDS_ITEMS = frozenset("ul ol dl table tbody thead tfoot".split())
# Whole classes, ids and roles, not parts of hyphenated ones, that mark what is not content.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription sidebar comment comments commentlist reply replies "
    "disqus share sharing social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation "
    "footer toolbar pagination pager widget login signup search skip copyright".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
SMOOTHING = (0.25, 0.5, 0.25)
THRESHOLD = 0.25  # of the page's typical score
THRESHOLD_INSIDE = 0.08  # the same for text in article or main, where short items are usual
LINK_SHARE = 0.8  # a path with more of its text in links is made of links
LINK_WEIGHT = 0.05
MARK_WEIGHT = 1 / 64  # for each marked element around a block
BARE_WEIGHT = 1 / 16  # of text in no element of PROSE
ARTICLE_ODDS = 8.0  # of text inside or beside an article that holds all or none of the page's text
SPARED = frozenset(("form",))  # elements of NEVER that pages wrap around their content
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^"'>])*+)>?|[!?/][^>]*>?)""", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links
    article: bool
    heading: bool
    prose: bool
    mark: int = -1  # the innermost marked element around it
    marks: int = 0  # marked elements around it that hold no article


@dataclass
class _Open:
    name: str
    label: str
    never: bool
    article: bool
    mark: int = -1


class _Page:
    """One reading of a page into blocks."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack = [_Open("", "", False, False)]
        self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.around: list[int] = []  # of each marked element the marked one around it, -1 for none
        self.holds: list[bool] = []  # whether it holds an article

    def flush(self) -> None:
        if self.text:
            own = " ".join("".join(self.text).split())
            top = next(e for e in reversed(self.stack) if e.name not in INLINE)
            if own and not self.stack[-1].never:
                path = tuple(e.label for e in self.stack if e.name not in INLINE)
                self.blocks.append(Block(path, own, self.linked, top.article, top.name in HEADINGS, top.name in PROSE, self.stack[-1].mark))
        self.text, self.linked = [], 0

    def add(self, text: str) -> None:
        if text and not self.stack[-1].never:
            text = unescape(text) if "&" in text else text
            self.text.append(text)
            if self.links:
                self.linked += len(text)

    def close_to(self, depth: int) -> None:
        if any(e.name not in INLINE for e in self.stack[depth:]):
            self.flush()
        self.links -= sum(e.name == "a" for e in self.stack[depth:])
        del self.stack[depth:]

    def start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.flush()
            for depth in range(len(self.stack) - 1, 0, -1):
                own = self.stack[depth].name
                if own == "p" or (own == name and name in CLOSES_ITS_OWN):
                    self.close_to(depth)
                    break
                if own not in INLINE and (name not in CLOSES_ITS_OWN or own in HOLDS_ITEMS):
                    break
        elif name == "br":
            self.add(" ")
        if name in VOID:
            return
        above = self.stack[-1]
        found = _MARK.findall(attributes) if "=" in attributes else ()
        tokens = {w for m in found for w in "".join(m).lower().split()}
        marks = [w for t in tokens for w in re.split(r"[^a-z]+", t) if w]
        article = above.article or name in ARTICLE
        never = above.never or (name in NEVER and name not in SPARED)
        mark = above.mark
        if name in ARTICLE and mark >= 0:
            self.holds[mark] = True
        elif name not in ROOTS:
            header = not article and (name == "header" or "header" in tokens)
            if name in SPARED or header or not MARKS.isdisjoint(tokens):
                self.around.append(mark)
                self.holds.append(False)
                mark = len(self.around) - 1
        label = name + "." + ".".join(sorted(set(marks))) if marks and name not in INLINE else name
        self.links += name == "a"
        self.stack.append(_Open(name, label, never, article, mark))

    def marked(self) -> list[Block]:
        """The blocks, each with the number of marked elements around it that hold no article."""
        for m in range(len(self.around) - 1, -1, -1):  # inner ones come later
            if self.around[m] >= 0:
                self.holds[self.around[m]] |= self.holds[m]
        depth: list[int] = []
        for m, outer in enumerate(self.around):
            depth.append((depth[outer] if outer >= 0 else 0) + (not self.holds[m]))
        for b in self.blocks:
            b.marks = depth[b.mark] if b.mark >= 0 else 0
        return self.blocks

    def end(self, name: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].name == name:
                self.close_to(depth)
                return
            if name in INLINE and self.stack[depth].name not in INLINE:
                return


def blocks_of(html: str) -> list[Block]:
    page, at = _Page(), 0
    while True:
        tag = _TAG.search(html, at)
        if tag is None:
            page.add(html[at:])
            break
        page.add(html[at : tag.start()])
        at = tag.end()
        if tag[2]:
            name = tag[2].lower()
            if tag[1]:
                page.end(name)
            else:
                page.start(name, tag[3])
                if name in RAW:
                    close = _ENDS[name].search(html, at)
                    at = close.end() if close else len(html)
                    page.end(name)
    page.flush()
    return page.marked()


def _priors(blocks: list[Block], length: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """What the names of the elements around a block say, as a factor of its score."""
    prior = np.where(linked, LINK_WEIGHT, 1.0)
    prior *= MARK_WEIGHT ** np.minimum([b.marks for b in blocks], 100)  # far below any score, above zero
    prior *= np.where([b.prose or b.heading for b in blocks], 1.0, BARE_WEIGHT)
    inside = np.array([b.article for b in blocks])
    if inside.any():
        weight = length * prior**2  # furniture counts for little, however long
        lean = 2 * weight[inside].sum() / weight.sum() - 1
        prior *= ARTICLE_ODDS ** np.where(inside, lean, -lean)
    return prior


def path_scores(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each block's path, and the score of that path: its fused ratios times its prior."""
    number: dict[tuple, int] = {}
    of = np.array([number.setdefault((b.path, b.marks), len(number)) for b in blocks])
    nodes = np.bincount(of)
    length = np.array([len(b.text) for b in blocks], float)
    signs = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    total = np.bincount(of, length)
    links = np.bincount(of, [b.linked for b in blocks]) > LINK_SHARE * total

    def smooth(x):
        return np.convolve(np.pad(x, 1, mode="edge"), SMOOTHING, "valid")

    text_ratio, sign_ratio = smooth((total / nodes)[of]), smooth((np.bincount(of, signs) / nodes)[of])
    # Logarithms: a short item beside long paragraphs is still of their order.
    fused = np.log1p(text_ratio) * (1 + np.log1p(sign_ratio)) * _priors(blocks, length, links[of])
    return of, np.bincount(of, fused) / nodes


def chosen(blocks: list[Block]) -> list[bool]:
    """Which blocks are content."""
    if not blocks:
        return []
    of, score = path_scores(blocks)
    own = score[of]
    heading = np.array([b.heading for b in blocks])
    inside = np.array([b.article for b in blocks])
    # The typical score, in which text counts by its length and its score; headings only where there is nothing else.
    weight = own * [len(b.text) for b in blocks] * (1.0 if heading.all() else ~heading)
    typical = (weight * own).sum() / weight.sum()
    keep = own >= typical * np.where(inside, THRESHOLD_INSIDE, THRESHOLD)
    if heading.all():
        return keep.tolist()
    keep &= ~heading
    homes = {b.path[:-1] for b, k in zip(blocks, keep, strict=True) if k}
    follows = False  # whether the next block that is no heading is content of an article
    for i in range(len(blocks) - 1, -1, -1):
        if heading[i]:
            keep[i] = blocks[i].path[:-1] in homes or (follows and inside[i])
        else:
            follows = bool(keep[i] and inside[i])
    return keep.tolist()


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, keep in zip(blocks, chosen(blocks), strict=True) if keep)


def extract_content(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys`` and the main ``text`` of each page."""
    picked = pages.select(*keys, html)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", `text` string"

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = pa.array([main_text(h.as_py()) for h in part.column(len(keys))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*keys, "text"])

    return picked.mapInArrow(run, schema)
