"""Main text of web pages by a least cut between content and boilerplate.

A page is parsed into blocks: the text between block-level tags. A linear classifier over tag, class,
length, link share and place scores each block; the score, at most MOST either way, becomes its capacity to
the content terminal or to the boilerplate terminal. Neighbouring blocks, and blocks under one parent or
grandparent, are tied by smoothness edges of the same order: all ties of a block together weigh a little less
than a sure verdict and more than an unsure one, so doubtful blocks go with those around them. The least cut
leaves on the content side the blocks that make up the text. Parsing takes time in proportion to the page,
however deep its elements.

Defined cases: null, empty and blank pages, and pages without content, give an empty text; a page without any tag
is text; the label of a button belongs to the sentence in which it stands, and to nothing elsewhere; broken markup is read as far as its tags can be told; null ids and urls are returned as they are; repeated
pages each give a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.mincut import least_cut

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript svg select iframe object textarea canvas audio video datalist title annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr br".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mlabeledtr maction menclose mglyph semantics annotation annotation-xml".split()
)
#: A start tag ends an open element of these kinds, looked for up to the next element that is not inline.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Start tags that may stand in a head; any other, and text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: In these, other languages are spoken: a tag can close itself. HTML is spoken again in POINTS, and from a tag of BACK on, which ends them.
FOREIGN, POINTS = frozenset(("svg", "math")), frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BACK = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
PART = re.compile(r"[a-z]+|\d+")

#: Elements and class or id words that speak against content; comments and the elements hold whatever is inside.
AGAINST = {"nav": 8, "footer": 8, "aside": 8, "header": 6, "form": 6, "dialog": 8, "menu": 8}
WORDS_AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription sharing widgets pagination pager toolbar topbar login teaser outbrain taboola".split()
)
#: Words that articles and their parts may be named by as well: prose without links outweighs them.
DOUBTS, DOUBT = frozenset("legal disclaimer copyright search related recommended recommendations social share signup alert toc widget".split()), 2.5
COMMENTS = frozenset("comment comments disqus respond reply replies commentlist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FOR = {"article": 4.0, "main": 3.0}
WORDS_FOR = frozenset("article content entry story post body main text".split())
MOST, TIE_NEXT, TIE_PARENT = 4.0, 1.2, 0.6
#: Elements whose sentences may hold a button.
SENTENCES = frozenset("p li dd td th blockquote h1 h2 h3 h4 h5 h6 figcaption".split())


@dataclass
class Block:
    text: str
    tag: str
    linked: float
    good: float
    bad: float
    parent: int
    grand: int


@dataclass
class Open:
    tag: str
    no: int
    good: float
    bad: float
    hard: bool
    silent: bool
    foreign: bool


class Blocks(HTMLParser):
    """Reads a page into blocks, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.in_links = self.links = self.made = 0
        self.stack = [Open("", 0, 0.0, 0.0, False, False, False)]
        self.boxes = [0]  # where the elements of the stack are that aren't inline
        self.where: dict[str, list[int]] = {}  # tag -> where it is open

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                box, up, over = (self.stack[k] for k in [*self.boxes[-1:-4:-1], 0, 0][:3])
                top = self.stack[-1]
                self.blocks.append(Block(text, box.tag, min(1.0, self.in_links / len(text)), top.good, top.bad, up.no if len(self.boxes) > 1 else box.no, over.no if len(self.boxes) > 2 else 0))
            self.parts, self.in_links = [], 0

    def close(self) -> None:
        super().close()
        self.flush()

    def push(self, x: Open) -> None:
        if x.tag not in INLINE:
            self.boxes.append(len(self.stack))
        self.where.setdefault(x.tag, []).append(len(self.stack))
        self.stack.append(x)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            x = self.stack.pop()
            self.where[x.tag].pop()
            self.links -= x.tag == "a"
        while self.boxes[-1] >= k:
            self.boxes.pop()

    def end_silent(self, tag: str) -> None:
        """Ends the head or the foreign elements that a start tag can't stand in."""
        top, head = self.stack[-1], self.where.get("head")
        if head and (top.tag == "head" and tag not in IN_HEAD or tag == "body" and not self.where.get("template")):
            self.pop_to(head[0])
        elif top.foreign and tag in BACK:
            k = len(self.stack)
            while self.stack[k - 1].foreign:
                k -= 1
            self.pop_to(k)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack[-1].silent or self.stack[-1].foreign:
            self.end_silent(tag)
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE and not self.stack[-1].foreign:
            self.flush()
            box = self.boxes[-1]
            if self.stack[box].tag == "p" or self.stack[box].tag in ENDS.get(tag, ()):
                self.pop_to(box)
        if tag in VOID:
            return
        up, own = self.stack[-1], dict(attrs)
        good, bad, hard = up.good, up.bad, up.hard
        silent = up.silent or tag in SILENT or "hidden" in own or "display:none" in (own.get("style") or "").replace(" ", "")
        if tag == "button" and not (self.stack[self.boxes[-1]].tag in SENTENCES and "".join(self.parts).strip()):
            silent = True
        if tag not in ("html", "body"):
            words = set(PART.findall(f"{own.get('class') or ''} {own.get('id') or ''}".lower()))
            against = 10.0 if words & COMMENTS else max(AGAINST.get(tag, 0), 8 if words & WORDS_AGAINST or own.get("role") in ROLES else 0)
            if tag in FOR and not words & COMMENTS:
                against = 8 if own.get("role") in ROLES else 0  # an article is one, whatever it is called
            doubt = DOUBT if words & DOUBTS and tag not in FOR else 0.0
            if tag == "header" and good and against == AGAINST["header"]:
                against = 0  # the heading of the article itself
            support = max(FOR.get(tag, 0.0), 3.0 if own.get("role") == "main" or own.get("itemprop") == "articleBody" else 0.0, 1.5 if words & WORDS_FOR and tag not in INLINE else 0.0)
            if support >= 3 and not hard:
                bad = min(bad, 1.5)  # a wrapper's name says less than the article in it
            if against:
                good, bad, hard = 0.0, max(bad, float(against)), hard or bool(words & COMMENTS) or tag in AGAINST
            elif not (bad and support < 3):
                good, bad = max(good, support), max(bad, doubt)
            else:
                bad = max(bad, doubt)
        self.made += 1
        self.push(Open(tag, self.made, good, bad, hard, silent, tag in FOREIGN or (up.foreign and tag not in POINTS)))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FOREIGN or self.stack[-1].foreign and tag not in BACK:
            self.handle_starttag(tag, attrs)
            if self.stack[-1].tag == tag:
                self.handle_endtag(tag)
        else:
            self.handle_starttag(tag, attrs)  # as browsers do: other elements end here only if they are void

    def handle_endtag(self, tag: str) -> None:
        at = self.where.get(tag)
        if tag not in INLINE and not (at and (tag in FOREIGN or self.stack[at[-1] - 1].foreign)):
            self.flush()
        if at and (tag not in INLINE or at[-1] > self.boxes[-1]):  # an inline element doesn't end what it stands in
            self.pop_to(at[-1])

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip():
            self.pop_to(len(self.stack) - 1)
        if not self.stack[-1].silent:
            self.parts.append(data)
            if self.links:
                self.in_links += len(data)


def score(b: Block) -> float:
    """Over 0 for content, under 0 for boilerplate."""
    by_tag = 1.5 if b.tag == "h1" else 0.5 if re.fullmatch("h[2-6]|p|pre|blockquote|figcaption", b.tag) else -0.3 if b.tag == "li" else 0.0
    return b.good - b.bad + by_tag + min(2.0, len(b.text) / 100) - 4 * b.linked - 0.8 - (2.0 if not b.good and re.search("©|all rights reserved", b.text, re.I) else 0.0)


def capacities(blocks: list[Block]) -> list[int]:
    """What it costs to call a block boilerplate, or, if negative, content: thousandths of its score."""
    return [round(1000 * max(-MOST, min(MOST, score(b)))) for b in blocks]


def ties(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """What it costs to part a block from the one before it, the more the nearer they are in the tree, and from the last one of its parent and grandparent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            near = 3 if a.parent == b.parent else 2 if {a.parent, a.grand} & {b.parent, b.grand} else 1
            edges.append((i - 1, i, round(1000 * TIE_NEXT * near / 3)))
        for kind, node in (("parent", b.parent), ("grand", b.grand)):
            if node and (j := last.get((kind, node), i)) < i - 1:
                edges.append((j, i, round(1000 * TIE_PARENT / (1 + (kind == "grand")))))
            last[kind, node] = i
    return edges


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.close()
    blocks = page.blocks
    if not page.made:
        return "\n\n".join(b.text for b in blocks)
    if not any(b.good for b in blocks):  # nothing is marked as the article: longer text must do
        for b in blocks:
            b.good = 0.3
    whole = capacities(blocks)
    edges = ties(blocks)
    stay = least_cut([max(0, x) for x in whole], [max(0, -x) for x in whole], edges)
    return "\n\n".join(b.text for b, s in zip(blocks, stay, strict=True) if s)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    rows = pages.select(id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["i", "u", "t", "n"])

    kinds = [rows.schema[k].dataType.simpleString() for k in range(2)]
    return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
