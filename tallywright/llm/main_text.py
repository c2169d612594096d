"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each element's density is its characters per tag, adjusted
by its links: much text in few links raises it, and links that hold most of the text lower it
below nothing. The sum of its child blocks' densities makes a container of many dense blocks
stand out, and the element with the highest sum is the core of the page. The lowest density on
the path from there up to the body is the page's threshold: wherever an element reaches it, the
element with the highest sum below is taken, with all that is in it.

Parts that are not an article by their element, role or name (menus, footers, forms, adverts,
comments and so on) are taken off the tree first. Names and forms only hint at that: such an
element stays if it holds most of the text in several blocks, as a wrapper of the page does,
and a name is a whole class or id. Where nothing is left, density decides without them.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import ready

# Names of HTML elements and of what surrounds articles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CLOSES_P | frozenset("body html li dt dd tr td th caption thead tbody tfoot summary legend option".split())
SIBLINGS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
#: An end tag or a sibling is not looked for beyond these.
SCOPES = frozenset("html body table ul ol dl select article section div main".split())
SURROUNDINGS = frozenset(
    "head nav footer aside form button select menu dialog svg canvas object audio video fieldset "
    "label datalist map search".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split()
)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay sidebar sidenav nav navbar navigation "
    "menu breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond reply replies "
    "related recommended share sharing social subscribe subscription newsletter signup login search "
    "pagination pager widget toolbar skip copyright legal disclaimer".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words beside a name that leave it a name: ``cookie-notice``, ``comment-list``, ``ad-1``.
PARTS = frozenset(
    "area bar block box button buttons container content form group holder inner item items link links list "
    "main site page post posts section slot top bottom left right text thread title unit wrap wrapper "
    "primary secondary sticky us".split()
)
#: Share of the plain text from which a named element or form is a wrapper of the page.
WRAPS = 0.5


class Page:
    """A tree of elements as parallel lists; element 0 stands for the page."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["#page"], [-1], [""]
        #: Pieces of text in page order: ``(element, text)``; a null text ends a block.
        self.text: list[tuple[int, str | None]] = []
        self._parse(source)

    def _open(self, tag: str, attributes: str, at: int) -> int:
        self.tag.append(tag)
        self.parent.append(at)
        self.names.append(attributes)
        return len(self.tag) - 1

    def _closed(self, at: int, tags: tuple[str, ...], scopes: frozenset[str]) -> int:
        """The parent of the nearest open element out of ``tags``, or ``at`` if none is in scope."""
        node = at
        while node > 0:
            if self.tag[node] in tags:
                return self.parent[node]
            if self.tag[node] in scopes:
                return at
            node = self.parent[node]
        return at

    def _parse(self, source: str) -> None:
        at, place, lower = 0, 0, None
        while place < len(source):
            token = _TOKEN.match(source, place)
            place = token.end()
            tag = token.group(2)
            if tag is None:
                if token.group(0)[:1] != "<" or token.group(0) == "<":
                    self.text.append((at, token.group(0)))
                continue
            tag = tag.lower()
            block = tag in BLOCKS
            if token.group(1):
                if block:
                    self.text.append((at, None))
                at = self._closed(at, (tag,), frozenset(("html", "body")) if tag not in ("html", "body") else frozenset())
                continue
            if tag in CLOSES_P:
                at = self._closed(at, ("p",), SCOPES)
            if tag in SIBLINGS:
                at = self._closed(at, SIBLINGS[tag], SCOPES)
            if block:
                self.text.append((at, None))
            node = self._open(tag, token.group(3), at)
            if tag in VOID:
                if tag in ("br", "hr"):
                    self.text.append((node, " " if tag == "br" else None))
            elif tag in RAW:
                if lower is None:
                    lower = source.lower()
                end = lower.find(f"</{tag}", place)
                close = source.find(">", end) if end >= 0 else -1
                place = len(source) if close < 0 else close + 1
            elif not token.group(3).endswith("/") or tag not in ("svg", "path"):
                at = node


def _named(value: str) -> bool:
    """Whether a class or id out of ``value`` is a name, with nothing but other names and parts."""
    for token in value.split():
        words = [w for w in re.split(r"[^a-z]+", _CAMEL.sub("-", token).lower()) if w]
        if not NAMES.isdisjoint(words) and NAMES.union(PARTS).issuperset(words):
            return True
    return False


def _surrounds(page: Page, node: int, keeps: list[bool], in_article: bool) -> int:
    """0 for what may be an article, 2 for what is none, 1 for what is none by its name only."""
    tag = page.tag[node]
    if tag in SURROUNDINGS or tag == "header" and not in_article:
        return 0 if keeps[node] else 1 if tag in ("form", "fieldset") else 2
    attributes = page.names[node]
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    by_name = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return 2
        if name == "role" and value.strip().lower() in ROLES:
            return 0 if keeps[node] else 1 if value.strip().lower() == "form" else 2
        by_name = by_name or name in ("class", "id") and _named(value)
    return int(by_name and not keeps[node])


def _plain(page: Page, off: list[bool]) -> list[int]:
    """Characters outside links of each element with all in it that is not off."""
    link, plain = [False] * len(off), [0] * len(off)
    for node in range(1, len(off)):
        link[node] = link[page.parent[node]] or page.tag[node] == "a"
    for node, text in page.text:
        if text is not None and not off[node] and not link[node]:
            plain[node] += len("".join(text.split()))
    for node in range(len(off) - 1, 0, -1):
        plain[page.parent[node]] += plain[node]
    return plain


def main_text(source: str) -> str:
    """The article of a page as blocks joined by empty lines; empty if there is no text."""
    page = Page(source)
    n = len(page.tag)
    tag, parent = page.tag, page.parent
    keeps = [False] * n
    for node in range(n - 1, 0, -1):
        if keeps[node] or tag[node] in ("article", "main", "body"):
            keeps[parent[node]] = True
    sure, hints, article = [False] * n, [False] * n, [False] * n
    for node in range(1, n):
        up = parent[node]
        article[node] = article[up] or tag[node] in ("article", "main")
        kind = 2 if tag[node] in RAW else _surrounds(page, node, keeps, article[node])
        sure[node], hints[node] = sure[up] or kind == 2, kind == 1
    off = sure
    if any(hints):
        plain, off, inside = _plain(page, sure), [False] * n, [0] * n
        for node in range(n - 1, 0, -1):
            inside[parent[node]] += inside[node] + (tag[node] in BLOCKS and plain[node] > 0)
        for node in range(1, n):
            off[node] = off[parent[node]] or sure[node] or hints[node] and (
                plain[node] < WRAPS * plain[0] or inside[node] < 2
            )
        if not any(text and text.strip() and not off[node] for node, text in page.text):
            off = sure

    characters, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for node in range(1, n):
        in_link[node] = in_link[parent[node]] or tag[node] == "a"
    pieces: list[tuple[int, str | None]] = []
    for node, text in page.text:
        if text is None:
            pieces.append((node, None))
        elif not off[node]:
            text = html.unescape(text) if "&" in text else text
            pieces.append((node, text))
            size = len("".join(text.split()))
            characters[node] += size
            if in_link[node]:
                links[node] += size
    for node in range(n - 1, 0, -1):
        if off[node]:
            continue
        up = parent[node]
        characters[up] += characters[node]
        links[up] += links[node]
        tags[up] += tags[node] + 1
        link_tags[up] += link_tags[node] + (tag[node] == "a")
    if not characters[0]:
        return ""

    body = next((i for i in range(1, n) if tag[i] == "body" and not off[i]), 0)
    if not characters[body]:
        body = 0
    ratio = links[body] / characters[body]
    density, total = [0.0] * n, [0.0] * n
    for node in range(n):
        if off[node] or not characters[node]:
            continue
        c, t = characters[node], max(1, tags[node])
        lc, lt = links[node], link_tags[node]
        plain = c - lc
        base = math.log(c / max(1, plain) * lc + ratio * c + math.e)
        adjusted = (c / max(1, lc)) * (t / max(1, lt))
        density[node] = c / t * math.log(max(adjusted, 1.0)) / math.log(max(base, math.e))
    # Only blocks are children here: marking a few words as bold makes no new block.
    holder = list(range(n))
    for node in range(1, n):
        if tag[node] not in BLOCKS:
            holder[node] = holder[parent[node]]
    for node in range(1, n):
        if holder[node] == node:
            total[holder[parent[node]]] += density[node]
    if not any(total):
        total = [density[i] if holder[i] == i else 0.0 for i in range(n)]

    best = max((i for i in range(n) if not off[i]), key=lambda i: (total[i], -i))
    threshold, node = density[best], best
    while node > 0:
        threshold = min(threshold, density[node])
        if node == body:
            break
        node = parent[node]
    # The element of the highest sum in each subtree, from the bottom up.
    top = list(range(n))
    for node in range(n - 1, 0, -1):
        up = parent[node]
        if total[top[node]] > total[top[up]]:
            top[up] = top[node]
    taken = [False] * n
    for node in range(n):
        if not off[node] and characters[node] and density[node] >= threshold and holder[node] == node:
            taken[top[node]] = True
    # Headings beside the core belong to it if both are in one article.
    above, node = set(), best
    while node > 0 and article[node]:
        node = parent[node]
        above.add(node)
    for node in range(1, n):
        heading = tag[node] in HEADINGS and not off[node] and article[node] and parent[node] in above
        taken[node] = taken[node] or taken[parent[node]] or heading

    blocks, current = [], []
    for node, text in [*pieces, (0, None)]:
        if text is None:
            if current and (joined := " ".join("".join(current).split())):
                blocks.append(joined)
            current = []
        elif taken[node]:
            current.append(text)
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Null or empty pages, and pages without text, give an empty text. Every row is read by
    itself, so repeated rows, null ids and null addresses stay. Other columns are ignored.
    """
    ready(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        work, "page_id long, url string, text string, n_chars long"
    )
