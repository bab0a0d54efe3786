"""Main text of a page by composite text density.

The page is parsed into a tree. Elements and roles that HTML itself gives to other things than text (menus,
page headers, footers, sidebars, notices, forms, scripts, styles) are left out. For every other node the
composite density is

    d = C / T * log_b(C / LC * T / LT),   b = max(e, ln(C / (C - LC) * LC + LCbody / Cbody * C + e))

with C characters, T tags, LC link characters and LT link tags of its subtree (a zero divisor counts as 1; without
the bound on b the logarithm has no base on pages with few links). Names add weight to this: text in a node whose
class or id names side matter, and nothing else, counts as link text, so that its density is 0. Names of controls
and lists of links (search, share, menu) do so only where the node has controls or links; a node with most of the
page's text in several paragraphs is the article whatever its name.

A node's density sum adds up the densities of its children. The node with the greatest sum is content, and the
least density on its path from the body is the threshold. From the body down, every child that reaches the
threshold is entered, and in each the subtree with the greatest sum is content as well. Among the brothers of
content these are content too, if they are neither side matter nor menus: headings before it, whatever lies between
two pieces of it, text elements of the same kind as one of them, and sections, however short, that are built as a
section of the content is: the same element with the same kind of first heading, with the same class too unless both
lie in an article. Within content, side matter and menus (three links or more and no other text, paragraphs apart)
below the threshold are left out. <article> and <main> are nodes like others for the densities.

Text: references decoded, white space in a block is one space, blocks are trimmed and joined by one newline, in
page order. Null or empty html gives an empty text; so does a page of side matter. Depth and length have no limit.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.html import Node, parse
from ..session import ship
from .common import arrow_map

OTHER_TAGS = frozenset("nav footer aside form script style noscript template iframe button select textarea svg canvas object dialog head menu".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Names of side matter that has a text of its own.
SIDE_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertisements adbox adsense sponsor sponsors sponsored promo promos
    promotion cookie cookies consent gdpr notice notices alert alerts popup modal aside sidebar sidebars footer
    copyright legal comment comments commentlist disqus replies respond
    """.split()
)
#: Names of controls and of lists of links.
LIST_NAMES = frozenset(
    """
    search login signup subscribe newsletter share sharing social pager pagination toc skip nav navbar navigation
    menu menubar breadcrumb breadcrumbs related recommended recommendations widget widgets header masthead topbar
    banner
    """.split()
)
#: Parts of names that say nothing about the content.
PLAIN_NAMES = frozenset(
    """
    wrap wrapper box area section list container block bar inner outer top bottom left right item items link links
    post posts panel col column group unit slot site page
    """.split()
)
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
    section summary table tbody tfoot thead tr ul
    """.split()
)
#: A paragraph of links is text.
MENU_TAGS = BLOCK_TAGS - {"p"}
ARTICLES = frozenset("article main section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW_TAGS = HEADINGS | frozenset("p ul ol dl pre table blockquote figure section address details".split())
CONTROLS = frozenset("a input button select textarea".split())
CELLS = frozenset(("td", "th", "br"))
PARAGRAPHS, MENU_LINKS = 3, 3


def _other(n: Node) -> bool:
    """Whether HTML itself says that a node is no text of the page."""
    if n.tag in OTHER_TAGS or n.attrs.get("role", "").lower() in OTHER_ROLES or "hidden" in n.attrs:
        return True
    if n.tag != "header" or any(x.tag in ("article", "main") for x in n.walk()):
        return False
    up = n.up  # the header of an article with its title is text, the page's is not
    while up is not None and up.tag not in ("article", "main"):
        up = up.up
    return up is None or not any(x.tag == "h1" for x in n.walk())


def prune(root: Node) -> Node:
    todo = [root]
    while todo:
        n = todo.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not _other(k)]
        todo += [k for k in n.kids if isinstance(k, Node)]
    return root


def named(n: Node, names: frozenset) -> bool:
    """Whether one of the node's names consists of such words and plain ones, one of them at least."""
    for name in (n.attrs.get("class", "") + " " + n.attrs.get("id", "")).lower().split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        if any(w in names for w in words) and all(w in names or w in PLAIN_NAMES for w in words):
            return True
    return False


def _size(s: str) -> int:
    return len(" ".join(s.split()))


class Page:
    """Figures of a page's nodes in page order; node 0 is the body."""

    def __init__(self, root: Node):
        self.body = next((n for n in root.walk() if n.tag == "body"), root)
        self.order = list(self.body.walk())
        m = len(self.order)
        self.at = {id(n): i for i, n in enumerate(self.order)}
        self.up = [0] + [self.at[id(n.up)] for n in self.order[1:]]
        self.end = list(range(1, m + 1))  # subtrees are ranges
        for i in range(m - 1, 0, -1):
            u = self.up[i]
            self.end[u] = max(self.end[u], self.end[i])
        self.own = [sum(_size(k) for k in n.kids if isinstance(k, str)) for n in self.order]
        self.c = self._sums(self.own)
        self.links = self._sums([int(n.tag == "a") for n in self.order])
        self.side = self._side()
        linked = [False] * m
        for i, n in enumerate(self.order):
            linked[i] = n.tag == "a" or self.side[i] or (i > 0 and linked[self.up[i]])
        self.lc = self._sums([o if x else 0 for o, x in zip(self.own, linked, strict=True)])
        inside = self._sums([1] * m)
        side = self._sums([int(x) for x in self.side])
        self.t = [x - 1 for x in inside]
        self.lt = [a if not s else max(a, k) for a, s, k in zip(self.links, self.side, self.t, strict=True)]
        self.plain = self.c[0] > self.lc[0] or not any(side)  # some text is no link text, or none is side matter
        self.d = [self._density(i) for i in range(m)]
        self.total = [0.0] * m
        for i in range(1, m):
            self.total[self.up[i]] += self.d[i]

    def _sums(self, x: list[int]) -> list[int]:
        x = list(x)
        for i in range(len(x) - 1, 0, -1):
            x[self.up[i]] += x[i]
        return x

    def _side(self) -> list[bool]:
        order, c = self.order, self.c
        controls = self._sums([int(n.tag in CONTROLS) for n in order])
        paragraphs = self._sums([int(n.tag == "p") for n in order])
        holds = self._sums([int(n.tag in ("article", "main")) for n in order])
        out = [False] * len(order)
        for i, n in enumerate(order):
            if i and out[self.up[i]]:
                out[i] = True
            elif i and n.attrs and not holds[i] and not (2 * c[i] > c[0] and paragraphs[i] >= PARAGRAPHS):
                out[i] = named(n, SIDE_NAMES) or (controls[i] > 0 and named(n, LIST_NAMES))
        return out

    def _density(self, i: int) -> float:
        c, lc, t, lt = self.c[i], self.lc[i], max(1, self.t[i]), max(1, self.lt[i])
        if not c or self.side[i]:
            return 0.0
        base = max(math.e, math.log(c / max(1, c - lc) * lc + self.lc[0] / self.c[0] * c + math.e))
        return c / t * max(0.0, math.log(c / max(1, lc) * t / lt)) / math.log(base)

    def threshold(self) -> tuple[int, float]:
        """(node of the greatest density sum, least density on its path from the body)."""
        best = max(range(len(self.order)), key=lambda i: (self.total[i], -i))
        if self.total[best] <= 0:
            best = max(range(len(self.order)), key=lambda i: (self.d[i], -i))
        least, x = self.d[best], best
        while x:
            x = self.up[x]
            least = min(least, self.d[x])
        return best, least

    def menu(self, i: int) -> bool:
        return self.links[i] >= MENU_LINKS and self.lc[i] >= self.c[i]

    def section(self, i: int) -> tuple[str, str] | None:
        """(tag, tag of its first heading) of a node that has a heading and plain text besides."""
        inside = range(i + 1, self.end[i])
        heads = [k for k in inside if self.order[k].tag in HEADINGS and self.c[k] and not self.side[k]]
        if not heads:
            return None
        titles = sum(self.c[k] - self.lc[k] for k in heads if self.order[self.up[k]].tag != "hgroup")
        return (self.order[i].tag, self.order[heads[0]].tag) if self.c[i] - self.lc[i] > titles else None

    def article(self, i: int) -> bool:
        """Whether the node lies in, or is, what HTML calls an article."""
        while i and self.order[i].tag not in ARTICLES:
            i = self.up[i]
        return self.order[i].tag in ARTICLES

    def content(self) -> list[int]:
        """The nodes whose text is the article, in page order, none inside another."""
        order, d, total = self.order, self.d, self.total
        if not self.c[0] or not self.plain:
            return []
        _, least = self.threshold()
        greatest = list(range(len(order)))  # of each subtree the node of the greatest sum, the first on a tie
        for i in range(len(order) - 1, 0, -1):
            u, g = self.up[i], greatest[i]
            if (total[g], -g) > (total[greatest[u]], -greatest[u]) and (total[g] > 0):
                greatest[u] = g
        marked: set[int] = set()
        todo = [0]
        while todo:
            i = todo.pop()
            n = greatest[i]
            while n > i and order[n].tag not in BLOCK_TAGS and order[n].tag not in CELLS:
                n = self.up[n]
            marked.add(n)
            todo += [k for k in self._kids(i) if d[k] >= least and d[k] > 0 and k != n]
        return self._outermost(self._with_brothers(self._outermost(marked)))

    def _kids(self, i: int):
        k = i + 1
        while k < self.end[i]:
            yield k
            k = self.end[k]

    def _outermost(self, marked: set[int]) -> list[int]:
        out: list[int] = []
        for i in sorted(marked):
            if not out or i >= self.end[out[-1]]:
                out.append(i)
        return out

    def _with_brothers(self, marked: list[int]) -> set[int]:
        own = set(marked)
        for u in {self.up[i] for i in marked if i}:
            kids = list(self._kids(u))
            inside = [j for j, k in enumerate(kids) if k in own]
            tags = {self.order[kids[j]].tag for j in inside}
            sections = {(self.section(kids[j]), self.order[kids[j]].attrs.get("class")) for j in inside}
            article = self.article(u)
            first = min([j for j in range(inside[-1]) if self.order[kids[j]].tag in HEADINGS and self.c[kids[j]] and not self.side[kids[j]]] + inside[:1])
            for j, k in enumerate(kids):
                tag, between = self.order[k].tag, first <= j <= inside[-1]
                if self.side[k] or not self.c[k] or self.menu(k) and not (tag == "p" and (article or between)):
                    continue
                s, name = self.section(k), self.order[k].attrs.get("class")
                alike = s is not None and ((s, name) in sections or article and any(s == x for x, _ in sections))
                if alike or between and (tag in HEADINGS or j >= inside[0]) or tag in FLOW_TAGS and tag in tags:
                    own.add(k)
        return own

    def text(self) -> str:
        content = self.content()
        if not content:
            return ""
        _, least = self.threshold()
        parts = [blocks(self.order[i], lambda n: self._left_out(self.at[id(n)], least)) for i in content]
        return "\n".join(p for p in parts if p)

    def _left_out(self, i: int, least: float) -> bool:
        return (self.side[i] or self.menu(i) and self.order[i].tag in MENU_TAGS) and self.d[i] <= least


def blocks(n: Node, left_out=lambda n: False) -> str:
    """The text of a node's blocks, without the nodes that are left out."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        s = " ".join("".join(run).split())
        if s:
            out.append(s)
        run.clear()

    todo: list = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            end()
        elif x is not n and left_out(x):
            if x.tag in BLOCK_TAGS:
                end()
        elif x.tag in BLOCK_TAGS:
            end()
            todo.append(None)
            todo += reversed(x.kids)
        else:
            if x.tag in CELLS:
                run.append(" ")
            todo += reversed(x.kids)
            if x.tag in CELLS:
                run.append(" ")
    end()
    return "\n".join(out)


def main_text(html: str | None) -> str:
    return Page(prune(parse(html))).text() if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    ship(pages.sparkSession)
    some = pages.select("page_id", "url", F.col(html).alias("html"))
    at = some.schema

    def f(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                texts = [main_text(h) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return some.transform(arrow_map, f, f"page_id {at['page_id'].dataType.simpleString()}, url {at['url'].dataType.simpleString()}, text string, n_chars long")
