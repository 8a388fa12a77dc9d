"""Main text of web pages, by two passes over their blocks.

A page is cut into blocks where block elements begin and end; elements that are
no text, or that say what they are (menus, adverts, comments), give none. The
first pass decides each block by its stop words, length and links; the second
lets those left open, mostly short ones, take the label of the nearest decided
neighbours. Each page is judged alone, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, parts, ship_package, sliced, table, without

#: Frequent function words of seven languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he at are this have from or which you they we "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat dass sie wird bei "
    "de la le et les en un une du que est pour qui dans par sur pas plus au avec ce il elle ne se aux ou "
    "el y los del las por con no su al lo como más o pero sus "
    "di e che per non sono si da i dei nel ha do em um para com não uma os na mais dos het van een dat op te voor met aan".split()
)
#: Words from which on a block can be good by itself; the share of stop words that it needs; the share of its letters in links that makes it bad.
WORDS, STOPS, LINKS = 10, 0.12, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold no text of a page, and those that stand beside its main text.
UNSEEN = frozenset("script style noscript template iframe object svg canvas select datalist button textarea audio video map head title".split())
BESIDE = frozenset("nav aside footer dialog menu".split())
HEAD = frozenset("head title meta link style script base noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id: what is never main text, as words and as beginnings of words, and what is none unless more says
#: that it goes around the text, or is a header inside it.
NEVER = frozenset(
    "ad ads promo promotion consent gdpr subscribe subscription signup comment comments commentlist kommentar kommentare commentaires comentarios reply replies respond "
    "discussion feedback talkback disqus share sharing social pagination pager nav navigation topnav subnav mainnav sidenav menu menus mainmenu submenu topmenu dropdown "
    "popup modal related recommended recommendations trending teaser teasers outbrain taboola".split()
)
NEVER_BEGINS = ("advert", "adsby", "adslot", "adunit", "sponsor", "cookie", "breadcrumb", "navbar", "newsletter")
RARELY = frozenset("banner notice notices announcement alert alerts sidebar side aside widget footer header masthead topbar toolbar login overlay copyright legal disclaimer".split())
AROUND = frozenset("page wrap wrapper container layout main".split())
INSIDE = frozenset("article content post entry story".split())
NEGATED = frozenset("has no with without is".split())
#: Elements of these kinds end where the next of their kind begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot div section article main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headings that begin readers' comments.
COMMENTS = re.compile(
    r"(?:\d+\s+)?(?:(?:reader |user )?comments?|responses?|replies|leave a (?:comment|reply)|(?:leser)?kommentare?|commentaires?|comentarios?|commenti|comentários?|reacties)(?:\s*\(?\d+\)?)?\s*:?", re.I
)
RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)
WORD = re.compile(r"[^\W\d_]+")

SEEN, WEAK, STRONG = range(3)


class Block(NamedTuple):
    """A block's text, its tag, how many of its characters are in links, whether in an article (2) or the page's main part (1), and its mark."""

    text: str
    tag: str
    linked: int
    scope: int
    mark: int


class _Frame(NamedTuple):
    tag: str
    mark: int
    scope: int


def _words_of(name: str) -> set[str]:
    return set(re.sub(r"[^a-z]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()).split())


def _mark(tag: str, attrs: dict[str, str], above: _Frame) -> int:
    """What an element says of itself."""
    if tag in ("html", "body"):
        return SEEN
    if tag in BESIDE or "hidden" in attrs or attrs.get("role", "").lower() in ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return STRONG
    mark = WEAK if tag == "form" or (tag == "header" and not above.scope) else SEEN
    for part in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = _words_of(part)
        if words & NEGATED:
            continue
        if words & NEVER or any(w.startswith(NEVER_BEGINS) for w in words) or ("sidebar" in words and not words & (AROUND | INSIDE)):
            return STRONG
        rare = words & RARELY
        if rare and not words & AROUND and not (words & INSIDE and rare == {"header"}) and tag not in ("article", "main"):
            mark = WEAK
    return mark


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile("[\"'>]")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements whose text holds no tags.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea iframe noframes noembed xmp".split()}
_LONG_NUMBER = re.compile(r"&#(?:[xX]0*[1-9a-fA-F][0-9a-fA-F]{8,}|0*[1-9][0-9]{8,}|[xX]?0{99,}[0-9a-fA-F]*);?")


def _decoded(text: str) -> str:
    """Character references decoded; a number that is no character gives a replacement."""
    return unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def _tag_end(html: str, at: int) -> int:
    """The place of the ``>`` that ends a tag, not counting those in quoted values; -1 if there is none."""
    end = html.find(">", at)
    inside = html[at : max(end, at)]
    if inside.count('"') % 2 == 0 and inside.count("'") % 2 == 0:
        return end
    while m := _QUOTE.search(html, at):
        if m.group() == ">":
            return m.start()
        at = m.end()
        if html[max(0, m.start() - 64) : m.start()].rstrip().endswith("="):
            close = html.find(m.group(), at)
            if close < 0:
                return end
            at = close + 1
    return end


class _Page:
    """The blocks of a page; each character is looked at once or twice, whatever is left open."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack = [_Frame("", SEEN, 0)]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.tag = ""
        self.link = 0  # the depth of the stack where a link began

    def read(self, html: str) -> list[Block]:
        at, size = 0, len(html)
        while at < size:
            tag = html.find("<", at)
            if tag < 0:
                tag = size
            if tag > at:
                self.data(html[at:tag])
            if tag == size:
                break
            at = tag + 1
            if html.startswith("!--", at):
                end = html.find("-->", at + 1)
                at = size if end < 0 else end + 3
            elif html.startswith(("!", "?"), at):
                end = html.find(">", at)
                at = size if end < 0 else end + 1
            elif name := _NAME.match(html, at + 1 if html.startswith("/", at) else at):
                end = _tag_end(html, name.end())
                at = size if end < 0 else end + 1
                own = name.group().lower()
                if end < 0:
                    pass
                elif html[tag + 1] == "/":
                    self.end(own)
                else:
                    self.start(own, html[name.end() : end])
                    if own in _RAW:
                        close = _RAW[own].search(html, at)
                        at = close.start() if close else size
            else:
                self.data("<")
        self.end_block()
        return self.blocks

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        top = self.stack[-1]
        if text and top.mark < STRONG:
            self.blocks.append(Block(text, self.tag or top.tag, self.linked, top.scope, top.mark))
            if COMMENTS.fullmatch(text):
                self._marked_above()
        self.parts.clear()
        self.linked, self.tag = 0, ""

    def _marked_above(self) -> None:
        """What follows in the element that holds this block is comments; the block itself goes too."""
        at = len(self.stack) - 1
        while at > 0 and self.stack[at].tag in HEADINGS | {"p"}:
            at -= 1
        if self.stack[at].tag not in ("", "html", "body"):
            self.blocks.pop()
            self.stack[at:] = [f._replace(mark=STRONG) for f in self.stack[at:]]

    def _pop_to(self, size: int) -> None:
        for f in self.stack[size:]:
            self.open[f.tag] -= 1
        del self.stack[size:]
        if self.link > size:
            self.link = 0

    def start(self, tag: str, inside: str) -> None:
        if tag == "br" or tag == "wbr":
            self.parts.append(" " if tag == "br" else "")
            return
        attrs = {k.lower(): _decoded(a or b or c) for k, a, b, c in _ATTR.findall(inside)} if "=" in inside or "hidden" in inside else {}
        if tag == "a":
            self.link = len(self.stack) if "href" in attrs else 0
        if self.open["head"] and tag not in HEAD:
            self._pop_to(next(k for k, f in enumerate(self.stack) if f.tag == "head"))
        above = self.stack[-1]
        if tag in UNSEEN:
            if tag not in VOID:
                if tag != "head" or not self.open["body"]:
                    self._push(tag, STRONG, above)
            return
        mark = _mark(tag, attrs, above) if attrs or tag in BESIDE or tag in ("form", "header") else SEEN
        if tag in INLINE and mark == SEEN:
            return
        self.end_block()
        if tag in VOID:
            return
        if tag not in INLINE and self.stack[-1].tag == "p":
            self._pop_to(len(self.stack) - 1)
        if tag in ENDS:
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].tag in HOLDERS:
                    break
                if self.stack[at].tag in ENDS[tag]:
                    self._pop_to(at)
                    break
        self._push(tag, mark, self.stack[-1], {"article": 2, "main": 1}.get(tag, int(attrs.get("role") == "main")))

    def _push(self, tag: str, mark: int, above: _Frame, scope: int = 0) -> None:
        # An article takes back what an element around it seemed to say.
        kept = SEEN if scope and above.mark == WEAK else above.mark
        self.stack.append(_Frame(tag, max(kept, mark), max(scope, above.scope)))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if not self.open[tag]:
            if tag not in INLINE and tag not in VOID:
                self.end_block()
            return
        if tag not in UNSEEN:
            self.tag = self.tag or (tag if tag in HEADINGS else "")
            self.end_block()
        at = len(self.stack) - 1
        while self.stack[at].tag != tag:
            at -= 1
        self._pop_to(at)

    def data(self, data: str) -> None:
        if self.stack[-1].mark == STRONG:
            return
        data = _decoded(data)
        self.parts.append(data)
        if self.link:
            self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in its order, without elements that are never main text."""
    return _Page().read(html)


def _decided(blocks: list[Block], scoped: bool, stop_words: frozenset[str]) -> list[bool | None]:
    """First pass: good, bad or open."""
    words = [WORD.findall(b.text.lower()) for b in blocks]
    stops = [sum(map(stop_words.__contains__, own)) for own in words]
    # Where a page holds no stop word at all, its language is not known, and they tell nothing.
    known = any(stops)
    out: list[bool | None] = []
    for b, own, n in zip(blocks, words, stops, strict=True):
        if b.linked > LINKS * len(b.text) or (not scoped and RIGHTS.match(b.text)):
            out.append(False)
        elif len(own) < WORDS and len(b.text) < 8 * WORDS:
            out.append(None)
        elif not known or n >= STOPS * len(own):
            out.append(True)
        else:
            out.append(None if scoped else False)
    return out


def _inherited(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Second pass: open blocks take the label of the nearest decided one, and of two as near the good one; headings take the next one's.

    Where no block is decided, all are good.
    """
    before: list[tuple[int, bool] | None] = []
    last = None
    for k, label in enumerate(labels):
        before.append(last)
        last = last if label is None else (k, label)
    out, following = [True] * len(blocks), None
    for k in range(len(blocks) - 1, -1, -1):
        label, earlier = labels[k], before[k]
        if label is not None:
            out[k], following = label, (k, label)
        elif earlier is None or following is None or blocks[k].tag in HEADINGS:
            out[k] = (following or earlier or (0, True))[1]
        elif k - earlier[0] == following[0] - k:
            out[k] = earlier[1] or following[1]
        else:
            out[k] = (earlier if k - earlier[0] < following[0] - k else following)[1]
    return out


def labelled(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> list[bool]:
    """Which blocks are main text.

    Of a page with articles, or else with a main part, only what is in them can
    be, unless nothing there is good by itself and something elsewhere is.
    Blocks in elements that seem to stand beside the text are looked at only
    where nothing else is there.
    """
    for mark in (SEEN, WEAK):
        own = [k for k, b in enumerate(blocks) if b.mark <= mark]
        if not own:
            continue
        first = None
        # The innermost scope with a block that is good by itself, else the innermost.
        for s in (2, 1, 0):
            inside = [k for k in own if blocks[k].scope >= s]
            some = [blocks[k] for k in inside]
            labels = _decided(some, s > 0, stop_words)
            first = first or (inside and (inside, labels))
            if True in labels:
                first = inside, labels
                break
        inside, labels = first
        good = _inherited([blocks[k] for k in inside], labels)
        taken = {k for k, g in zip(inside, good, strict=True) if g}
        if taken:
            return [k in taken for k in range(len(blocks))]
    return [False] * len(blocks)


def main_text(html: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The main text's blocks, joined by spaces."""
    found = blocks_of(html)
    return " ".join(b.text for b, good in zip(found, labelled(found, stop_words), strict=True) if good)


def extract(pages: DataFrame, *, html_col: str = "html", stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """``pages`` with the main ``text`` of each and its code points ``n_chars``, instead of columns of these names.

    A null html counts as empty; a page without main text gives ``''``. Pages
    are taken whole, however long or broken; rows that repeat are rows each, and
    no rows give none.
    """
    ship_package(pages.sparkSession)
    words = frozenset(stop_words)

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [main_text(h, words) for part in parts([batch]) for h in part]
            yield pd.Series(found, dtype=object)

    kept = without(pages, *({"text", "n_chars"} - {html_col.lower()}))
    return kept.withColumn("text", made(F.coalesce(column(html_col), F.lit("")))).withColumn("n_chars", F.char_length("text").cast("long"))


def page_blocks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """``(id, block, tag, text, linked, main)``: every block of each page with its label, to see why a page's text is what it is."""
    ship_package(pages.sparkSession)
    words = frozenset(stop_words)
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[tuple] = []
            for at, html in enumerate(batch.column(1).to_pylist()):
                found = blocks_of(html or "")
                rows += [(at, k, b.tag, b.text, b.linked, good) for k, (b, good) in enumerate(zip(found, labelled(found, words), strict=True))]
            at, *others = zip(*rows, strict=True) if rows else [()] * 6
            arrays = [batch.column(0).take(pa.array(at, pa.int64()))]
            arrays += [pa.array(c, k) for c, k in zip(others, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "block", "tag", "text", "linked", "main"])

    made = pages.select(column(id_col), column(html_col)).mapInArrow(run, f"id {kind}, block int, tag string, text string, linked long, main boolean")
    return made.withColumnRenamed("id", id_col)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
