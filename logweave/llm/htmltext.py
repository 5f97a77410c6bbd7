"""Main text of web pages by tag-path ratios.

A page is cut into text nodes; every node has its root-to-leaf tag path (steps
are tags with their class and id names).  Per path the text length and the
punctuation are added up and divided by its number of nodes.  The two ratios,
laid along the page in node order, are smoothed with a small Gaussian, fused into
one curve and thresholded at its standard deviation: long, punctuated, repeated
paths (paragraphs) stand out from menus, buttons and captions.  The innermost
element that holds all of the selected text is the article, with the headings
before it and the ``article`` or ``main`` around it; its short blocks (a heading, a
one-word paragraph) belong to it, blocks of links when they are selected or stand
among its paragraphs or in ``article`` or ``main``, and whatever else stands between its blocks.  Steps that name
something else (``nav``, ``footer``, ``class="ad"``, comments, forms, hidden
elements) never count.  A class or id says so as a whole name (``cookie-notice``,
``adbox``, not ``no-sidebar``; of comments and cookies also in a longer one), and names and forms are not heeded on an element that holds
most of the page's text while no ``article`` or ``main`` with text lies outside it,
that has a ``main`` inside, or that wraps the text of an ``article`` or ``main``;
only comments are comments at any length, unless nothing else is on the page.

Markup is read the forgiving way: unclosed or stray tags, comments, attributes
with ``>`` in quotes, script text with tags in it and truncated pages.  Character
references are decoded, white space inside a block becomes one blank, blocks are
joined by a newline; nothing else is dropped or cut.  Work is linear in the page.

Defined cases: a null or empty page, or one without content, gives an empty text;
repeated rows and extra columns pass unchanged (own output columns replace those
of the input).
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import SLICE_ROWS

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr br img input svg math picture source".split())
CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",),
                 "dd": ("dl",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
P_BARRIER = frozenset("html body table td th caption button object template".split())

# Steps of a path that never lead to the article.
NEVER_TAGS = frozenset(
    "head script style noscript template nav header footer aside button select option textarea iframe object embed "
    "svg math canvas audio video dialog menu input label map noembed noframes".split())
FORM_TAGS = frozenset(("form", "fieldset"))
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup "
    "login nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer foot "
    "sidebar side aside rail widget widgets share sharing social related recommended recommendations comment comments "
    "commentlist disqus reply replies respond discussion feedback search skip toolbar tags copyright legal".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion feedback".split())
LOOSE_NAMES = frozenset("comment comments commentlist disqus cookie cookies gdpr".split())  # in longer names too
HAVING = frozenset("no not has have with without open closed off free enabled disabled allow allowed".split())
BESIDE_NAMES = frozenset(  # parts of a name that leave its meaning to the others
    "area bar block body bottom box button buttons col column container form global google group icon icons inner item items "
    "left link links list main module outer page panel post primary right row secondary section site slot top unit wrap "
    "wrapper".split())
NEVER_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
WHOLE = frozenset("html body main article".split())  # their names say nothing against their content

ROOTS = frozenset(("#", "html", "body"))
CONTAINERS = frozenset("html body main article section div td table tbody tr center figure".split())
SHORT_BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption article section main address summary".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

SMOOTH = np.exp(-0.5 * np.arange(-2, 3) ** 2)
WRAPS = 0.9         # an element in an article with this share of its text is its wrapper
MOST = 0.5          # an element with more of the text than this is the page, whatever its name
HEADINGS = frozenset("h1 h2 h3".split())
LINK_SHARE = 0.6    # blocks with more of their text in links do not say where the article is

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(["'])|([^\s>]*+)))?+)""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


def _words(name: str) -> list[str]:
    """The words of a name; one like ``adbox`` or ``leftnav``, of two known words, is cut."""
    out = []
    for w in _NAME.findall(name):
        w = w.lower()
        if w in NEVER_NAMES or w in BESIDE_NAMES:
            out.append(w)
        elif not w.isdigit():
            cuts = [(w[:k], w[k:]) for k in range(2, len(w) - 1)]
            out += next((c for c in cuts if c[0] in NEVER_NAMES and c[1] in BESIDE_NAMES or c[0] in BESIDE_NAMES and c[1] in NEVER_NAMES), (w,))
    return out


@lru_cache(4096)
def _meaning(name: str) -> str:
    """What a class or id speaks for: "comments", "beside" the article, or "" for nothing of the kind.

    A name of known words only is taken at its word; in a longer one comments and cookies still
    speak for something beside the article, unless the name says that it is about having them.
    """
    parts = _words(name)
    if not all(w in NEVER_NAMES or w in BESIDE_NAMES for w in parts):
        loose = any(w in LOOSE_NAMES for w in parts) and not any(w in HAVING for w in parts)
        return "beside" if loose else ""
    return "comments" if any(w in COMMENT_NAMES for w in parts) else "beside" if any(w in NEVER_NAMES for w in parts) else ""


class Page:
    """Text nodes of a page: text, path, element and block of each."""

    def __init__(self, html: str):
        self.parent, self.tag, self.never, self.link = [-1], ["#"], [False], [False]
        self.named = [""]                     # what an element's own name speaks for: "", "beside" or "comments"
        self.path = [0]                       # path number of each element
        self.paths: dict[tuple[int, str], int] = {}
        self.texts: list[str] = []
        self.element: list[int] = []
        self.block: list[int] = []
        self._open = [0]
        self._endless: set[int] = set()
        self._places: dict[str, list[int]] = {}  # of each tag, its places among the open elements
        self._block = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            name = m[2]
            if not name:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"), False)
                continue
            tag = name.lower()
            attributes, at = self._attributes(html, at)
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                close = _RAW_END[tag].search(html, at)
                at = close.end() if close else n
                self._end(tag)

    def _attributes(self, html: str, at: int) -> tuple[list[tuple[str, str]], int]:
        """Names and values up to the end of the tag, and that end.  Quoted values are
        read whole; a tag that does not end this way ends at its first ``>``."""
        if html.startswith(">", at):
            return [], at + 1
        found, k, quotes = [], at, []
        while (m := _ATTRIBUTE.match(html, k)) and not m[1]:
            k, value = m.end(), m[4] or ""
            if m[3]:
                close = -1 if k in self._endless else html.find(m[3], k)
                quotes.append(k)
                if close < 0:
                    m = None
                    break
                value, k = html[k:close], close + 1
            found.append((m[2].lower(), value))
        if m:
            return found, m.end()
        self._endless.update(quotes)  # no tag that comes by one of these quotes ends
        end = html.find(">", at)
        end = len(html) if end < 0 else end
        found, k = [], at
        while m := _ATTRIBUTE.match(html, k, end):
            k, value = m.end(), m[4] or ""
            if m[3]:
                close = html.find(m[3], k, end)
                value, k = (html[k:end], end) if close < 0 else (html[k:close], close + 1)
            found.append((m[2].lower(), value))
        return found, min(end + 1, len(html))

    def _text(self, text: str, decode: bool = True) -> None:
        self.texts.append(unescape(text) if decode and "&" in text else text)
        self.element.append(self._open[-1])
        self.block.append(self._block)

    def _pop(self) -> None:
        tag = self.tag[self._open.pop()]
        self._places[tag].pop()
        if tag not in INLINE:
            self._block += 1

    def _start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if tag not in INLINE:
            self._block += 1
            if self._places.get("p"):
                self._close("p", P_BARRIER)
            if tag in CLOSES_ITSELF and self._places.get(tag):
                self._close(tag, CLOSES_ITSELF[tag])
        if tag == "br":
            self._text(" ", False)
        if tag in VOID:
            return
        up = self._open[-1]
        step, never, named = self._step(tag, attributes)
        e = len(self.tag)
        self.parent.append(up)
        self.tag.append(tag)
        self.never.append(self.never[up] or never)
        self.named.append(named)
        self.link.append(self.link[up] or tag == "a")
        self.path.append(self.paths.setdefault((self.path[up], step), len(self.paths) + 1))
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append(e)

    def _step(self, tag: str, attributes: list[tuple[str, str]]) -> tuple[str, bool, str]:
        never, names, named = tag in NEVER_TAGS, "", "beside" if tag in FORM_TAGS else ""
        for key, value in attributes:
            if key in ("class", "id"):
                names += f".{value}"
                if tag not in WHOLE:
                    named = max(named, *map(_meaning, value.split()), "")
            elif key == "role":
                never = never or value.lower() in NEVER_ROLES
                named = max(named, "beside" if value.lower() == "form" else "")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                never = True
            elif key == "style":
                never = never or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        return tag + names, never, named

    def _close(self, tag: str, barrier) -> None:
        """Ends an open element of this tag unless a barrier stands above it."""
        at = self._places[tag][-1]
        if all(not above or above[-1] < at for above in map(self._places.get, barrier)):
            while len(self._open) > at:
                self._pop()

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._block += 1
        if not self._places.get(tag):
            return
        while self.tag[self._open[-1]] != tag:
            self._pop()
        self._pop()


def fused_ratio(path: np.ndarray, length: np.ndarray, marks: np.ndarray, smooth: bool = True) -> np.ndarray:
    """The fused, smoothed tag-path ratio of each node."""
    kinds, path = np.unique(path, return_inverse=True)
    n = np.bincount(path, minlength=len(kinds))
    curves = []
    for amount in (length, marks):
        ratio = (np.bincount(path, amount, len(kinds)) / n)[path]
        weight = np.convolve(np.ones(len(path)), SMOOTH, "same") if smooth and len(path) >= 5 else None
        curves.append(np.convolve(ratio, SMOOTH, "same") / weight if weight is not None else ratio)
    return np.sqrt(curves[0] * (1 + curves[1]))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    never = _never(page)
    at = [i for i, t in enumerate(page.texts) if not never[page.element[i]] and not t.isspace()]
    if not at:
        return ""
    element = [page.element[i] for i in at]
    length = np.array([len("".join(page.texts[i].split())) for i in at], float)
    marks = np.array([len(PUNCTUATION.findall(page.texts[i])) for i in at], float)
    path = np.array([page.path[e] for e in element])
    z = fused_ratio(path, length, marks)
    least = min(z.std(), z.max())
    chosen = z >= least
    own = chosen & (fused_ratio(path, length, marks, False) >= least)  # not by its neighbours only
    # blocks: what the nodes of a block say together
    facts: dict[int, list] = {}
    for i, e, n, good, alone in zip(at, element, length.tolist(), chosen.tolist(), own.tolist()):
        f = facts.setdefault(page.block[i], [0.0, 0.0, 0.0, 0.0, e])
        f[0] += n
        f[1] += n * good
        f[2] += n * alone
        f[3] += n * page.link[e]
    texty = {b for b, (n, good, _, linked, _) in facts.items() if 2 * good >= n and linked <= LINK_SHARE * n}
    home, marked = _homes(page)
    inside = _article(page, at, home, own, texty)
    strong = [b for b in facts if b in texty and inside[facts[b][4]]]
    first, last = (strong[0], strong[-1]) if strong else (0, -1)
    homes = {home[facts[b][4]] for b in strong}
    bounded = page.tag[_top(inside)] not in ROOTS  # an element of its own, not the whole page
    picked = set()
    for b, (n, good, alone, linked, e) in facts.items():
        if not inside[e]:
            continue
        tag, among = _block_tag(page, e), home[e] in homes
        short = tag in SHORT_BLOCKS and (bounded or among or first <= b <= last or tag in ("h1", "h2"))
        if linked > LINK_SHARE * n:
            if 2 * alone >= n or short and (among or marked[e]):
                picked.add(b)
        elif 2 * good >= n or short or (first <= b <= last and good):
            picked.add(b)
    if picked and bounded:  # what stands between its blocks belongs to it, whatever the tag; in an article everything
        whole = page.tag[_top(inside)] == "article"
        low, high = min(picked), max(picked)
        picked |= {b for b, (n, _, _, linked, e) in facts.items() if inside[e] and linked <= LINK_SHARE * n and (whole or low < b < high)}
    out, now, last_block = [], [], None
    for i, t in enumerate(page.texts):
        b = page.block[i]
        if b not in picked or never[page.element[i]]:
            continue
        if b != last_block:
            out.append(now)
            now, last_block = [], b
        now.append(t)
    out.append(now)
    lines = (" ".join("".join(x).split()) for x in out)
    return "\n".join(x for x in lines if x)


def _top(inside: list[bool]) -> int:
    return next((e for e, ok in enumerate(inside) if ok), 0)


def _never(page: Page) -> list[bool]:
    """Which elements never count: by tag, role or style, or by a name that is heeded."""
    if not any(page.named):
        return page.never
    parent, n = page.parent, len(page.tag)

    def spread(own: list[bool]) -> list[bool]:
        for e in range(1, n):
            own[e] = own[e] or own[parent[e]]
        return own

    def amounts(out: list[bool]) -> list[int]:
        total = [0] * n
        for t, e in zip(page.texts, page.element):
            if not out[e]:
                total[e] += len("".join(t.split()))
        for e in range(n - 1, 0, -1):
            total[parent[e]] += total[e]
        return total

    comments = spread([a or b == "comments" for a, b in zip(page.never, page.named)])
    total = amounts(comments)
    if not total[0]:  # nothing but comments
        comments, total = page.never, amounts(page.never)
    marks = [0] * n  # article and main elements with text, in each element
    mains = [0] * n  # of them, main
    titles = [0] * n  # headings' text
    around = [0] * n  # the article or main an element lies in
    for e in range(1, n):
        up = parent[e]
        around[e] = up if page.tag[up] in ("article", "main") else around[up]
    for e in range(n - 1, 0, -1):
        marks[e] += page.tag[e] in ("article", "main") and total[e] > 0
        mains[e] += page.tag[e] == "main" and total[e] > 0
        titles[e] = total[e] if page.tag[e] in HEADINGS else titles[e]
        for sums in (marks, mains, titles):
            sums[parent[e]] += sums[e]

    def heed(e: int) -> bool:
        if mains[e] or page.tag[e] in FORM_TAGS and marks[e]:
            return False
        if around[e]:  # a wrapper leaves hardly more than a heading outside
            return total[e] - titles[e] < WRAPS * (total[around[e]] - titles[around[e]])
        return total[e] <= MOST * total[0] or marks[e] < marks[0]

    heeded = [name == "beside" and total[e] > 0 and heed(e) for e, name in enumerate(page.named)]
    out = spread([a or b for a, b in zip(comments, heeded)])
    return out if any(amounts(out)) else comments


def _block_tag(page: Page, e: int) -> str:
    while page.tag[e] in INLINE and page.parent[e] > 0:
        e = page.parent[e]
    return page.tag[e]


def _homes(page: Page) -> tuple[list[int], list[bool]]:
    """The innermost container of each element, and whether it lies in ``article`` or ``main``."""
    home, marked = [0] * len(page.tag), [False] * len(page.tag)
    for e in range(1, len(home)):  # children are numbered after their parents
        up, tag = page.parent[e], page.tag[e]
        home[e] = e if tag in CONTAINERS else home[up]
        marked[e] = marked[up] or tag in ("article", "main")
    return home, marked


def _article(page: Page, at: list[int], home: list[int], own: np.ndarray, texty: set[int]) -> list[bool]:
    """Which elements belong to the innermost container of all selected text."""
    nodes = [i for i, alone in zip(at, own.tolist()) if alone and page.block[i] in texty] \
        or [i for i in at if page.block[i] in texty] or at
    total = [0] * len(page.tag)
    for i in nodes:
        total[page.element[i]] += 1
    for e in range(len(total) - 1, 0, -1):
        total[page.parent[e]] += total[e]
    top = max(home[e] for e in range(len(total)) if total[e] == total[0])  # these lie one in the other
    titled = {home[page.element[i]] for i in at if i < nodes[0] and _block_tag(page, page.element[i]) in HEADINGS}
    up = top
    while page.tag[up] not in ROOTS:
        if up in titled or page.tag[up] in ("article", "main"):
            top = up
        up = home[page.parent[up]]
    inside = [False] * len(total)
    inside[top] = True
    for e in range(top + 1, len(total)):
        inside[e] = inside[page.parent[e]]
    return inside


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``df`` without ``html_col`` and with the main text and its number of code points."""
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c not in (html_col, text_col, count_col)]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(text_col, T.StringType()),
                           T.StructField(count_col, T.LongType())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                texts = [main_text(h) for h in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[*keep, text_col, count_col])

    return df.select(*keep, html_col).mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", F.col("text"), F.col("n_chars"))
