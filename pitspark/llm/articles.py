"""Operator 11: main text of raw HTML pages by tag-path ratios.

A page is a tree of elements and a sequence of text blocks, each with its root-to-leaf tag path. Elements that never
hold an article (menus, forms, scripts, ...) and elements named like one are set aside first. Text length, its spread,
punctuation and link share are aggregated per path, fused into one score, smoothed along the page among neighbours on
similar paths, and compared with a threshold; the article is the part of the page that holds most of the text on
accepted paths. Pages are independent: one pass over the table, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.2  # of the mean score, weighted by text, that an accepted path reaches
SPREAD = 1.0  # of the Gaussian over neighbouring blocks
REACH = 3  # neighbours that count on either side
SHARE = 0.8  # of the accepted text that a part of the page holds to be the article
DEEPEST = 512  # open elements; whatever is nested deeper becomes a sibling, as in browsers
LINKED = 0.8  # share of link text of a path that makes it a list of links

# Names of HTML elements by what they mean for a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NEVER = frozenset(
    "head script style title noscript template nav menu aside footer form input button select option textarea label fieldset "
    "iframe object embed applet svg math canvas audio video map dialog search xmp noembed noframes datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var wbr img picture nobr output meter progress".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("p li dt dd pre figcaption caption address summary".split())
HOLDERS = FLOW | frozenset("ul ol dl table thead tbody tfoot tr td th figure hgroup blockquote header details".split())
# A start tag of the first kind ends an open element of the second, up to an element of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
}
SCOPES = frozenset("table td th caption template html".split())

# Words of class names, ids and roles that say what is not the article.
CUES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager masthead topbar header footer colophon copyright contentinfo "
    "sidebar aside complementary widget widgets related recommended recommendations trending popular rail "
    "notice notices cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer toast dialog "
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion promoted "
    "form search searchbox login comment comments commentlist disqus respond reply replies discussion share sharing social skip".split()
)
_HEADER = frozenset("header masthead topbar banner".split())
_NOT = frozenset("no not with has is without free open enabled".split())
_TITLED = frozenset("content article post entry story".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|<[!?/](?:[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$|[\"'])", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+", re.IGNORECASE)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def _named(name: str) -> int:
    """1: named like something beside the article, 2: like the page's header, 0: neither."""
    words = {w.lower() for w in _WORD.findall(_CAMEL.sub(r"\1 \2", name))}
    found = words & CUES
    if not found or words & _NOT or (found <= _HEADER and words & _TITLED):
        return 0
    return 2 if found & _HEADER else 1


def _cue(attributes: str) -> tuple[int, bool]:
    """(as ``_named``, marked as the main part); what is hidden counts as beside the article."""
    aside, main = 0, False
    for name, *values in _NAMES.findall(attributes):
        value, name = next(filter(None, values), ""), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            aside = 1
        elif name == "style":
            aside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "role":
            main |= value.lower() in ("main", "article")
            aside |= _named(value)
        else:
            for one in value.split():
                aside |= _named(one)
    return aside, main


class Page:
    """Elements (parent, tag, aside, part of the main text) and blocks (element, text, characters in links)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.aside, self.main = [-1], [""], [0], [False]
        self.owner: list[int] = []
        self.texts: list[str] = []
        self.links: list[int] = []
        self._run: list[str] = []
        self._linked: list[str] = []
        self._stack = [0]
        self._in_link = 0
        self._read(html)

    def _flush(self) -> None:
        if self._run:
            text = " ".join(unescape("".join(self._run)).split())
            if text:
                self.owner.append(self._block())
                self.texts.append(text)
                self.links.append(min(len(text), sum(len("".join(unescape(t).split())) for t in self._linked)))
            self._run, self._linked = [], []

    def _block(self) -> int:
        """The innermost open element that is no link or other inline element."""
        return next((e for e in reversed(self._stack) if self.tag[e] not in INLINE or self.aside[e]), 0)

    def _open(self, name: str, aside: int, main: bool) -> None:
        if len(self._stack) >= DEEPEST:
            self._stack.pop()
        self._stack.append(len(self.parent))
        self.parent.append(self._stack[-2])
        self.tag.append(name)
        self.aside.append(aside)
        self.main.append(main)

    def _close(self, names, until=SCOPES) -> None:
        """Close the innermost open element of one of the names, unless an element of ``until`` lies between."""
        for at in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[at]]
            if tag in names:
                del self._stack[at:]
                return
            if tag in until:
                return

    def _read(self, html: str) -> None:
        at, end, match = 0, len(html), _TOKEN.search
        while at < end:
            found = match(html, at)
            start = found.start() if found else end
            if start > at:
                self._run.append(html[at:start])
                if self._in_link:
                    self._linked.append(html[at:start])
            if not found:
                break
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                self._inline(name, found["end"], found["attributes"])
                continue
            if name == "br":
                self._run.append(" ")
                continue
            self._flush()
            if found["end"]:
                if name == "p" and "p" not in map(self.tag.__getitem__, self._stack):
                    continue
                self._close((name,) if name not in HEADINGS else HEADINGS)
                self._in_link = 0
                continue
            if name in CLOSES_P and any(self.tag[e] == "p" for e in self._stack):
                self._close(("p",), SCOPES | {"button"})
            if name in ENDS:
                self._close(*ENDS[name])
            if name in RAW:
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = closing.end() if closing else end
                continue
            if name in VOID:
                continue
            if name in ("html", "body"):
                if name == "body":
                    self._close(("head",))
                if any(self.tag[e] == name for e in self._stack):
                    continue
            aside, main = _cue(found["attributes"]) if found["attributes"] else (0, False)
            if "-" in name:
                aside |= _named(name)
            if name == "main":  # can only lie inside one of these when their end tag is missing
                while any(self.tag[e] in NEVER for e in self._stack):
                    self._stack.pop()
            self._open(name, aside, main or name in ("main", "article"))
        self._flush()

    def _inline(self, name: str, end: str | None, attributes: str) -> None:
        if end:
            if name == "a":
                self._in_link = 0
            for at in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[at]]
                if tag not in INLINE:
                    break
                if tag == name:
                    self._flush()
                    del self._stack[at:]
                    break
            return
        if name == "a":
            self._in_link = 1
        aside, _ = _cue(attributes) if attributes else (0, False)
        if aside:
            self._flush()
            self._open(name, aside, False)


def _set_aside(page: Page) -> np.ndarray:
    """Elements whose text is never the article's: by kind or name, and all they hold.

    A name does not count where the element holds the main part or the page's first h1; a form that holds them is the
    page's own. A header counts unless it lies in an article or holds the main part.
    """
    n = len(page.parent)
    main, titled = [False] * n, [False] * n  # holds the main part, the first h1
    title = next((e for e in range(n) if page.tag[e] == "h1"), None)
    for e in range(n):
        for held, here in ((main, page.main[e] and not page.aside[e] and page.tag[e] != "article"), (titled, e == title)):
            up = page.parent[e] if here else -1
            while up >= 0 and not held[up]:
                held[up] = True
                up = page.parent[up]
    out, within = np.zeros(n, bool), [False] * n
    for e in range(1, n):
        up, tag, named = page.parent[e], page.tag[e], page.aside[e]
        within[e] = within[up] or page.main[up]
        held = main[e] or titled[e]
        if tag in ("html", "body", "main"):
            own = False
        elif tag == "form":
            own = not held
        elif tag == "header" or named & 2:
            own = not within[e] and not main[e]
        else:
            own = tag in NEVER or (named > 0 and not held and e != title)
        out[e] = out[up] or own
    return out


def _paths(page: Page) -> list[tuple[str, ...]]:
    """Tag path of every element; inline elements leave no trace."""
    paths: list[tuple[str, ...]] = [()]
    for e in range(1, len(page.parent)):
        up, tag = paths[page.parent[e]], page.tag[e]
        paths.append(up if tag in INLINE else (*up, tag))
    return paths


def path_scores(paths: list[tuple[str, ...]], texts: list[str], links: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed score of every block's path, path number of every block).

    Per path: characters and punctuation marks per block, and the spread of the blocks' lengths. The three are fused as
    a product, weakened by the share of link text, and smoothed over neighbouring blocks by a Gaussian weighted by the
    common part of their paths; a path's score is the mean over its blocks.
    """
    number: dict[tuple[str, ...], int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in paths])
    length = np.array([len(t) for t in texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], float)
    linked = np.array(links, float)
    count = np.bincount(which)
    mean = lambda values: np.bincount(which, values) / count
    chars, spread = mean(length), np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0))
    share = mean(linked) / np.maximum(chars, 1)
    score = (chars * (1 + mean(marks)) * (1 + spread)) ** (1 / 3) * (1 - share)
    each = score[which]
    total, weight = each.copy(), np.ones(len(each))
    for apart in range(1, min(REACH, len(each) - 1) + 1):
        near = np.array([_alike(a, b) for a, b in zip(paths[:-apart], paths[apart:], strict=True)]) * np.exp(-(apart**2) / (2 * SPREAD**2))
        total[:-apart] += near * each[apart:]
        total[apart:] += near * each[:-apart]
        weight[:-apart] += near
        weight[apart:] += near
    return mean(total / weight)[which], which


def _alike(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Common beginning of two paths over the longer one."""
    if a is b or a == b:
        return 1.0
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return same / max(len(a), len(b), 1)


def main_text(html: str) -> str:
    """The article's text: blocks in page order, joined by one space; empty when the page has none."""
    page = Page(html)
    aside = _set_aside(page)
    left = [b for b, e in enumerate(page.owner) if not aside[e]]
    if not left:
        return ""
    paths = _paths(page)
    owner = [page.owner[b] for b in left]
    texts, links = [page.texts[b] for b in left], [page.links[b] for b in left]
    score, which = path_scores([paths[e] for e in owner], texts, links)
    length = np.array([len(t) for t in texts], float)
    accepted = score >= THRESHOLD * (score @ length / length.sum())
    listed = (np.bincount(which, links) > LINKED * np.bincount(which, length))[which]
    accepted &= ~listed

    mass, whole = np.zeros(len(page.parent)), np.zeros(len(page.parent))  # accepted text, all text inside every element
    np.add.at(mass, owner, length * accepted)
    np.add.at(whole, owner, length)
    for e in range(len(mass) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
        whole[page.parent[e]] += whole[e]
    marked = [e for e in range(1, len(mass)) if page.main[e] and not aside[e] and mass[e] > 0]
    tagged = [e for e in marked if page.tag[e] != "main"] or marked
    zone = 0
    if tagged:
        zone = max(tagged, key=lambda e: (mass[e], e))  # the innermost of equal ones
        keep = _inside(page, zone, owner) & ~(listed & (np.bincount(which)[which] > 1))
    else:
        children: dict[int, list[int]] = {}
        for e in range(1, len(mass)):
            children.setdefault(page.parent[e], []).append(e)
        while True:
            best = max((c for c in children.get(zone, ()) if not aside[c] and page.tag[c] not in FLOW), key=mass.__getitem__, default=None)
            if best is None or mass[best] < SHARE * mass[zone] or mass[best] == 0:
                break
            zone = best
        keep = _inside(page, zone, owner) & (accepted | (np.array([_beside(page, e, mass, whole) for e in owner]) & ~listed))
        titles = [b for b, e in enumerate(owner) if page.tag[e] == "h1"]
        if len(titles) == 1 and keep.any() and titles[0] < np.argmax(keep):  # a title above the container of its text
            keep[titles[0]] = True
    return " ".join(t for t, k in zip(texts, keep, strict=True) if k)


def _beside(page: Page, e: int, mass: np.ndarray, whole: np.ndarray) -> bool:
    """Whether a heading, list item, cell or short paragraph stands in a container whose text is accepted for the most part."""
    if page.tag[e] not in HOLDERS:
        return False
    while e and page.tag[e] in HOLDERS:
        e = page.parent[e]
    return mass[e] >= 0.5 * whole[e] > 0


def _inside(page: Page, zone: int, owner: list[int]) -> np.ndarray:
    inside = np.zeros(len(page.parent), bool)
    inside[zone] = True
    for e in range(zone + 1, len(inside)):
        inside[e] = inside[page.parent[e]]
    return inside[owner]


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``df`` (page_id, url, html); other columns are not read.

    Null and empty pages, and pages without an article, have the empty text. Null ids and urls and repeated rows stay.
    White space is what Unicode calls so; character references are decoded; a text without markup is one block. Pages
    are read whole; a task holds one page's text and tree at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "") for html in batch.column("html")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
