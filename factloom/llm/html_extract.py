"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path (tags with their classes; inline tags do not count).
Per path the page's text length, punctuation and link text are aggregated, the ratios are smoothed over the page's order,
fused, and paths over a threshold are content; the node that holds their blocks is the article, and its blocks, short ones
and headings included, are the text.  Paths through elements that are never content (menus, footers, forms, adverts,
comments, scripts and the like, by tag, role, class or id) have ratio zero.

Each page is one row and is read by itself: no shuffle, nothing grows with the number of pages.

Defined results: null or empty html, or a page without a content block, gives an empty text of 0 characters.  Repeated rows
each get their result; a table without rows gives none.  Other columns are dropped; ids do not leave Spark.  Pages may be of
any length and cut off anywhere: open elements end with the page.  A line break inside a block counts as white space.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import reach_workers

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[,.;:!?…、。，！？]")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Their content is text up to their own end tag.
_RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
_HEAD = frozenset("base link meta noscript script style template title".split())
_NEVER = _RAW | frozenset("aside button canvas datalist dialog footer form head input map menu nav object option search select svg template video audio".split())
#: Their start and end do not part the text around them.
_QUIET = frozenset("button canvas noscript object script style svg template".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening the first ends an open element of the second, within the nearest of the third.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
         "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"})}
_SCOPE = frozenset("article aside body button caption main nav section table td th".split())

_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of a class or id that tell what is not the article.
_SURELY = frozenset("ad ads advert adverts advertisement advertising adsense comment comments consent cookie cookies disqus gdpr newsletter outbrain popup modal sponsor sponsored sponsors subscribe taboola".split())
_LIKELY = frozenset("alert banner breadcrumb breadcrumbs copyright disclaimer discussion footer header login masthead menu nav navbar navigation notice notices pager pagination promo promoted "
                    "recommended related replies respond search share sharing sidebar signup skip social teaser toolbar widget widgets".split())
#: Beside these, a likely word describes the layout.
_LAYOUT = frozenset("article body col column container content entry has layout main no page post story text with without wrap wrapper".split())


@lru_cache(4096)
def _kind(tag: str, attributes: str) -> tuple[str, bool]:
    """The tag with its classes, and whether by its attributes it is no content."""
    if not attributes or attributes.isspace():
        return tag, False
    has: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        has.setdefault(name.lower(), "".join(values))
    label = ".".join([tag, *sorted(has.get("class", "").split())])
    if tag in ("html", "body"):
        return label, False
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", has.get("style", ""), re.I):
        return label, True
    if has.get("role", "").lower() in _ROLES:
        return label, True
    for name in [*has.get("class", "").split(), has.get("id", "")]:
        words = {w.lower() for w in _WORD.findall(name)}
        if words & _SURELY or words & _LIKELY and not words & _LAYOUT and tag not in ("main", "article"):
            return label, True
    return label, False


class _Page:
    """Blocks of a page: (node, text, link characters); nodes have a parent, a tag, a path and say whether they are content at all."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.never = [-1], [""], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.open: list[tuple[str, int]] = []  # inline elements have their block's node
        self.count: dict[str, int] = {}
        self.pieces: list[str] = []
        self.links = 0
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            self.start(tag, m[3])
            if tag in _RAW:
                over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = over.end() if over else end
                self.close(tag)
        self.flush()

    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def text(self, raw: str) -> None:
        if not self.never[self.node()]:
            text = unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.count.get("a"):
                self.links += len(text)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.node(), text, min(self.links, len(text))))
            self.pieces, self.links = [], 0

    def drop(self, size: int) -> None:
        """Ends the open elements beyond the first `size`."""
        if any(t not in _INLINE and not self.never[n] for t, n in self.open[size:]):
            self.flush()
        for t, _ in self.open[size:]:
            self.count[t] -= 1
        del self.open[size:]

    def upto(self, tags: set[str], within: set[str] | frozenset[str]) -> None:
        if any(self.count.get(t) for t in tags):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in tags:
                    return self.drop(i)
                if self.open[i][0] in within:
                    return None

    def start(self, tag: str, attributes: str) -> None:
        if self.count.get("head") and tag not in _HEAD:
            self.upto({"head"}, frozenset())
        if tag == "br":
            self.text(" ")
        if tag in _VOID:
            if tag not in _INLINE:
                self.flush()
            return
        if tag not in _INLINE and tag not in _QUIET and not self.never[self.node()]:
            if tag in _ENDS:
                self.upto(*_ENDS[tag])
            self.upto({"p"}, _SCOPE)
            self.flush()
        label, never = _kind(tag, attributes)
        inside = self.node()
        if tag == "header" and not (self.count.get("article") or self.count.get("main")):
            never = True
        never = never or tag in _NEVER or self.never[inside]
        if tag not in _INLINE or never and not self.never[inside]:
            key = self.path[inside], label
            self.parent.append(inside)
            self.tag.append(tag)
            self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
            self.never.append(never)
            inside = len(self.parent) - 1
        self.open.append((tag, inside))
        self.count[tag] = self.count.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return self.drop(i)
            if tag in _INLINE and self.open[i][0] not in _INLINE:
                return None

    def above(self, node: int):
        while node > 0:
            yield node
            node = self.parent[node]


#: Weights of a block's neighbours at a distance of 0, 1 and 2 when ratios are smoothed.
_SMOOTH = (0.4, 0.24, 0.06)
#: A path is content from this share of the page's mean, weighed by text.
_SHARE = 0.5


def _selected(page: _Page) -> set[int]:
    """Paths whose smoothed and fused ratios reach the threshold."""
    sums: dict[int, list[float]] = {}
    for node, text, links in page.blocks:
        s = sums.setdefault(page.path[node], [0, 0, 0, 0])
        for k, x in enumerate((len(text), len(_PUNCTUATION.findall(text)), links, 1)):
            s[k] += x
    ratios = {p: (chars / n, 1 + marks / n, 1 - links / chars) for p, (chars, marks, links, n) in sums.items()}
    row = [ratios[page.path[node]] for node, _, _ in page.blocks]
    fused: dict[int, list[float]] = {}
    for i, (node, text, _) in enumerate(page.blocks):
        near = [(_SMOOTH[abs(j - i)], row[j]) for j in range(max(0, i - 2), min(len(row), i + 3))]
        whole = sum(w for w, _ in near)
        length, marks = (sum(w * r[k] for w, r in near) / whole for k in (0, 1))
        f = fused.setdefault(page.path[node], [0.0, 0])
        f[0] += length * marks * row[i][2] * min(1.0, row[i][0] / length if length else 0.0)
        f[1] += 1
    score = {p: total / n for p, (total, n) in fused.items()}
    mean = sum(score[page.path[node]] * len(text) for node, text, _ in page.blocks) / sum(len(text) for _, text, _ in page.blocks)
    return {p for p, s in score.items() if s >= _SHARE * mean}


def _articles(page: _Page, content: set[int]) -> set[int]:
    """Outermost article elements, or main ones, that hold blocks of content paths; empty if there are none."""
    for tags in ({"article"}, {"main", "article"}):
        held: dict[int, int] = {}
        inside = whole = 0
        for node, text, _ in page.blocks:
            tops = [n for n in page.above(node) if page.tag[n] in tags]
            if page.path[node] in content:
                whole += len(text)
                inside += len(text) * bool(tops)
            if tops:
                held[tops[-1]] = held.get(tops[-1], 0) + len(text) * (page.path[node] in content)
        if held and (2 * inside >= whole or tags == {"main", "article"}):
            return {n for n, size in held.items() if size} or {max(held, key=lambda n: (held[n], -n))}
        if held and not any(t == "main" for t in page.tag):
            return {n for n, size in held.items() if size} or set(held)
    return set()


def _container(page: _Page, content: set[int]) -> int:
    """The deepest node with four fifths of the text on content paths; a node above paragraphs."""
    mass: dict[int, int] = {}
    whole = 0
    for node, text, _ in page.blocks:
        if page.path[node] in content:
            whole += len(text)
            for n in [*page.above(node), 0]:
                mass[n] = mass.get(n, 0) + len(text)
    best = max(n for n, m in mass.items() if 5 * m >= 4 * whole)  # a node's number is over its parent's; those with four fifths lie on one line
    while page.tag[best] in _HEADINGS | {"p", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "pre", "blockquote"} and page.parent[best] >= 0:
        best = page.parent[best]
    return best


def main_text(html: str | None) -> str:
    """The blocks of the article, joined by line ends."""
    page = _Page(html or "")
    if not page.blocks:
        return ""
    content = _selected(page)
    tops = _articles(page, content)
    if tops:
        return "\n".join(text for node, text, _ in page.blocks if any(n in tops for n in page.above(node)))
    top = _container(page, content)
    inside = [top == 0 or any(n == top for n in page.above(node)) for node, _, _ in page.blocks]
    own = {page.path[node] for (node, _, _), k in zip(page.blocks, inside) if k} & content
    inside = [k or page.path[node] in own for (node, _, _), k in zip(page.blocks, inside)]
    first = inside.index(True)
    while first and page.tag[page.blocks[first - 1][0]] in _HEADINGS:  # a heading right before the container
        first -= 1
        inside[first] = True
    return "\n".join(text for (node, text, links), k in zip(page.blocks, inside) if k and (page.path[node] in content or 2 * links <= len(text)))


@F.pandas_udf(StringType())
def _main_text(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, one row a page."""
    reach_workers(pages.sparkSession)
    return pages.select("page_id", "url", _main_text(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
