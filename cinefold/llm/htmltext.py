"""Main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from math import exp, log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import small_batches

#: Elements by their part in a page.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose text a page never shows as its own, forms among them.
SILENT = frozenset(
    "head form button select option input dialog template svg math object applet canvas audio video map datalist fieldset legend script style textarea title xmp iframe noembed noframes noscript".split()
)
#: Elements and words of class, id and role attributes that hint at what isn't the article.
HINT_TAGS = frozenset("nav header footer aside menu menuitem".split())
HINT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments comentarios commentaires consent cookie cookies complementary contentinfo "
    "copyright dialog disqus discussion footer footnav gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion "
    "related reply replies respond search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Elements that hold running text themselves, those in lists and tables among them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt table thead tbody tfoot tr td th caption blockquote pre figcaption address summary".split())
#: An open element that one of these opening closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Headings, and the elements that are the page itself.
HEADINGS, OUTER = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(("", "html", "body"))
_SCOPES = frozenset("ul ol table div article section body td blockquote".split())
#: Words that may stand beside a hint in a compound name, as in ad-box or site-footer.
NEUTRAL_WORDS = frozenset("area article articles bar block body bottom box button buttons container content form group inner inside item items left link links list main outer page panel post posts right section site slot text title top unit wrap wrapper".split())
#: Elements that name the article, in which headers are its own.
NAMED = frozenset("article main".split())
#: Share of a path's text in links at which it is a list of links, and the share of the mean fused ratio under which its
#: text isn't content.
LINKED, THRESHOLD = 0.6, 0.1
#: Weight of text that stands in a container itself though the page has paragraphs, and times their text that it must
#: have, per block, to keep its weight.
WEAK, LONG = 0.02, 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")


def _hinted(tag: str, attributes: str, named: bool) -> bool:
    """Whether an element's tag, or a whole name that its attributes give it, is one of boilerplate.

    A compound name counts if nothing in it but hints and neutral words stands: ad-box does, search-engines doesn't.
    ``named``: it stands in an element that names the article, whose header is the article's own.
    """
    if tag in HINT_TAGS:
        return not (named and tag == "header")
    if not attributes or tag in ("html", "body") or tag in NAMED:
        return False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _NAME_PARTS.findall(name)}
            if words & HINT_WORDS and words <= HINT_WORDS | NEUTRAL_WORDS:
                return True
    return False


def _tokens(html: str) -> Iterator[tuple]:
    """("text", text), ("open", tag, attributes) and ("close", tag) in page order; comments and declarations vanish."""
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            yield "text", html[at:]
            return
        if m.start() > at:
            yield "text", html[at : m.start()]
        at = m.end()
        if m[1] is not None:
            yield "text", m[1].replace("&", "&amp;")
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            yield "close", tag
            continue
        yield "open", tag, m[4] if m[4] is not None else m[7]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            yield "close", tag


class Page:
    """A page's blocks of text, its block-level elements, and its tag paths, in page order.

    A block lies between block-level tags; inline tags don't end it. Elements and paths are numbered as they open, each
    with its parent's number, so that nothing but the text grows with the depth.
    """

    def __init__(self, html: str):
        #: (element, path, text, characters in links, whether a hint names it) of every block.
        self.blocks: list[tuple[int, int, str, int, bool]] = []
        #: Parent and tag of every element; number 0 is the page.
        self.elements: list[tuple[int, str]] = [(-1, "")]
        #: (parent, tag) of every path to its number.
        self.paths: dict[tuple[int, str], int] = {(-1, ""): 0}
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, bool, bool, int, int]] = []  # tag, silent, hinted, element, path
        places: dict[str, list[int]] = {}  # of the open elements of each tag
        blocks: list[int] = []  # places of the open block-level elements
        silent = hints = links = linked = named = 0
        text: list[str] = []

        def flush() -> None:
            nonlocal linked
            if text:
                whole = " ".join(unescape("".join(text)).split())
                if whole:
                    self.blocks.append((*(stack[-1][3:] if stack else (0, 0)), whole, linked, hints > 0))
                text.clear()
            linked = 0

        def pop(to: int) -> None:
            nonlocal silent, hints, links, named
            if blocks and blocks[-1] >= to:
                flush()
                while blocks and blocks[-1] >= to:
                    blocks.pop()
            for tag, quiet, hint, _, _ in stack[to:]:
                silent, hints, links, named = silent - quiet, hints - hint, links - (tag == "a"), named - (tag in NAMED)
                places[tag].pop()
            del stack[to:]

        def nearest(tags: Iterable[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        for token in _tokens(html):
            kind = token[0]
            if kind == "text":
                if not silent:
                    text.append(token[1])
                    linked += len(token[1]) if links else 0
                continue
            tag = token[1]
            if kind == "close":
                at = nearest((tag,))  # an inline element isn't closed from inside a block that it holds
                if at >= 0 and (tag not in INLINE or not blocks or at > blocks[-1]):
                    pop(at)
                continue
            if tag == "br":
                text.append(" ")
            elif tag not in INLINE:
                flush()
                ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag not in VOID else frozenset())
                at = nearest(ends)  # a paragraph ends where a block begins, an item where its next does
                if at >= 0 and at >= nearest(_SCOPES):
                    pop(at)
            if tag not in VOID:
                element, path = stack[-1][3:] if stack else (0, 0)
                quiet, hint = tag in SILENT or bool(_HIDDEN.search(token[2])), _hinted(tag, token[2], named > 0)
                if tag not in INLINE:
                    path = self.paths.setdefault((path, tag), len(self.paths))
                    self.elements.append((element, tag))
                    element = len(self.elements) - 1
                    blocks.append(len(stack))
                elif quiet > silent or hint > hints:
                    flush()
                silent, hints, links, named = silent + quiet, hints + hint, links + (tag == "a"), named + (tag in NAMED)
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, quiet, hint, element, path))
        flush()


_KERNEL = [exp(-(k * k) / 2) for k in range(-2, 3)]


def _smoothed(values: list[float]) -> list[float]:
    """A Gaussian mean of every value and its four neighbours."""
    out = []
    for i in range(len(values)):
        near = [(_KERNEL[k + 2], values[i + k]) for k in range(-2, 3) if 0 <= i + k < len(values)]
        out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    return out


def passing(page: Page, hints: bool) -> list[bool]:
    """Whether each block is content by the ratios of its tag path.

    A path has a text ratio (characters outside links per block) and a punctuation ratio (marks per block), both
    smoothed over the order in which the paths appear and fused on a logarithmic scale. A path passes whose fused ratio
    is a tenth of the mean over the page's text, and whose text isn't mostly links. Text that stands in a container
    itself counts little beside paragraphs, unless it is far longer than they are. What a hint names doesn't pass.
    """
    tags = {number: tag for (_, tag), number in page.paths.items()}
    paths: dict[tuple[int, bool], list[float]] = {}
    for _, path, text, linked, hint in page.blocks:
        own = paths.setdefault((path, hint and hints), [0, 0, 0, 0])
        own[0] += 1
        own[1] += max(0, len(text) - linked)
        own[2] += len(_PUNCTUATION.findall(text))
        own[3] += len(text)
    means = zip(*((own[1] / own[0], own[2] / own[0]) for own in paths.values()), strict=True)
    fused = dict(zip(paths, (log1p(a) * (1 + log1p(b)) for a, b in zip(*(_smoothed(list(x)) for x in means), strict=True)), strict=True))
    running = sum(own[1] for (path, hint), own in paths.items() if tags[path] in LEAVES and tags[path] not in HEADINGS and not hint)
    weak = {p for p, own in paths.items() if tags[p[0]] not in LEAVES and tags[p[0]] not in OUTER and own[1] < LONG * running * own[0]}
    fused = {p: f * (WEAK if p in weak else 1) for p, f in fused.items()}
    weight = {p: own[1] * (WEAK if p in weak else 1) for p, own in paths.items()}
    mean = sum(fused[p] * w for p, w in weight.items()) / max(sum(weight.values()), WEAK)
    good = {p for p, own in paths.items() if not p[1] and fused[p] >= THRESHOLD * mean and own[3] - own[1] < LINKED * own[3]}
    return [(path, hint and hints) in good for _, path, _, _, hint in page.blocks]


def main_text(html: str, hints: bool = True) -> str:
    """The article's text: the blocks of the content nodes in page order, joined by one space.

    Content nodes are chosen by the ratios of the tag paths (``passing``). From the page down, an element gives way to
    the one child that holds all passing text, and to an article or main element that holds most of it; the last one is
    the content's root. An element that holds running text itself is the article, or a section of it, and is kept whole,
    lists of links and short lines included; of an element that only holds others, those are kept that have content, and
    what stands between them. Of the page itself what passes is kept, and what stands between. ``hints``: what names as
    boilerplate mark is left out of all this; without them, or if nothing else is there, the ratios decide alone.
    """
    page = Page(html)
    good = passing(page, hints) if page.blocks else []
    if not any(good):
        return main_text(html, False) if hints and page.blocks else ""
    n = len(page.elements)
    score, direct = [0] * n, [False] * n
    tags = {number: tag for (_, tag), number in page.paths.items()}
    for (element, path, text, _, _), ok in zip(page.blocks, good, strict=True):
        if ok:
            score[element] += len(text)
            leaf = tags[path] in LEAVES
            direct[page.elements[element][0] if leaf and element else element] = True
    children: dict[int, list[int]] = {}
    for e in range(n - 1, 0, -1):
        parent = page.elements[e][0]
        score[parent] += score[e]
        if score[e]:
            children.setdefault(parent, []).append(e)
        if direct[e] and page.elements[e][1] in LEAVES:  # text of a list's item stands in what holds the list
            direct[parent] = True
    root = 0
    while not direct[root] or page.elements[root][1] in OUTER:
        below = children.get(root, [])
        only = [e for e in below if score[e] == score[root] or page.elements[e][1] in NAMED and 2 * score[e] >= score[root]]
        if not only or page.elements[only[0]][1] in LEAVES:
            break
        root = only[0]
    # whole: kept with all that stands in them; open: decided for each of their children
    whole, open_ = [False] * n, [False] * n
    open_[root] = True
    for e in range(root, n):
        parent = page.elements[e][0]
        if e > root and whole[parent]:
            whole[e] = True
        elif e == root or open_[parent] and score[e]:
            whole[e] = page.elements[e][1] in LEAVES or direct[e] and page.elements[e][1] not in OUTER
            open_[e] = not whole[e]
    inside = [False] * n
    for e in range(root, n):
        inside[e] = e == root or inside[page.elements[e][0]]
    sure = [whole[b[0]] or ok and inside[b[0]] for b, ok in zip(page.blocks, good, strict=True)]
    at = [i for i, x in enumerate(sure) if x]
    span = range(at[0], at[-1] + 1) if at else range(0)
    return " ".join(page.blocks[i][2] for i in span if (sure[i] or inside[page.blocks[i][0]]) and not (hints and page.blocks[i][4]))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All rows and columns with text, the page's main text (empty if none), and n_chars, its code points.

    Null and empty pages have an empty text; unclosed, misnested and very long markup is read to its end; repeated rows
    are handled alike; columns named text and n_chars are replaced; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    out = pages.withColumn("text", text(F.coalesce(F.col(html), F.lit(""))))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
