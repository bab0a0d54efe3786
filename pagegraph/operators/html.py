"""Stored HTML: main content, Markdown, links, child links of a page tree, asset names.

HTML needs a parser that Spark lacks, so these are Arrow-batched UDFs that see (page, html) only.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.text import slug

# Where the content of a page may be, in order of preference.
CONTENT_PLACES = ("#main-content", "#content", ".wiki-content", "article", "main")
# Roots of a page tree, in order; sections that list children; which of them are taken.
TREE_ROOTS = (".plugin_pagetree", ".ia-splitter-left", "#page-tree", "#sidebar", "#children-section", "#main-content .childpages-macro")
CHILD_SECTIONS = ("#children-section", ".childpages-macro", ".children-show-hide")
TAKEN_SECTIONS = CHILD_SECTIONS[:2]
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
FENCES = frozenset("table ul ol div article section td th body".split())
#: Comments, scripts and styles, which hold no references, or the & of what is none of the four basic references.
NO_BASIC_REFERENCE = re.compile(r"(?s)(<!--.*?(?:-->|\Z)|<((?i:script|style))\b.*?(?:</(?i:\2)|\Z))|&(?!quot;|amp|lt;|gt;)")


class Node:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def walk(self):
        """Nodes of the subtree in page order, without recursion."""
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo += [k for k in reversed(x.kids) if isinstance(k, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.kids)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close_implied(self, tag: str) -> None:
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        if not ends:
            return
        x = self.at
        while x.up is not None and x.tag not in FENCES or x.tag in ends:
            if x.tag in ends:
                self.at = x.up
                x = self.at
                continue
            if x.up is None:
                break
            x = x.up

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self._close_implied(tag)
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x.up is not None and x.tag != tag:
            x = x.up
        if x.up is not None:
            self.at = x.up

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    html = html or ""
    if (i := html.rfind("<!--")) >= 0 and html.find("-->", i) < 0:
        html += "-->"  # a comment that is never closed goes on to the end
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _is(n: Node, place: str) -> bool:
    if place[0] == "#":
        return n.attrs.get("id") == place[1:]
    if place[0] == ".":
        return place[1:] in n.attrs.get("class", "").split()
    return n.tag == place


def _classes(n: Node, *names: str) -> bool:
    return not set(names).isdisjoint(n.attrs.get("class", "").split())


def reveal(root: Node) -> None:
    """Put the label of each tab before what its pane holds, as a heading: panes and tabs of a group of tabs go by their
    order, panels by the id that a tab names. Each pane gets one label; a pane of an empty label gets none."""
    labelled: set[int] = set()

    def put(pane: Node, label: str) -> None:
        if label and id(pane) not in labelled:
            labelled.add(id(pane))
            head = Node("h4", {}, pane)
            head.kids.append(f"Aba: {label}")
            pane.kids.insert(0, head)

    every = list(root.walk())
    for group in (n for n in every if _classes(n, "aui-tabs")):
        inside = [n for n in group.walk() if n is not group]
        in_menus = {id(x) for m in inside if _classes(m, "tabs-menu") for x in m.walk() if x is not m}
        tabs = [n for n in inside if id(n) in in_menus and (n.tag == "li" or _classes(n, "menu-item"))]
        panes = [n for n in inside if _classes(n, "tabs-pane", "tab-pane")]
        for pane, tab in zip(panes, tabs, strict=False):
            put(pane, tab.text().strip())
    panels = [n for n in every if n.attrs.get("role") == "tabpanel"]
    for tablist in (n for n in every if n.attrs.get("role") == "tablist"):
        tabs = [n for n in tablist.walk() if n is not tablist and n.attrs.get("role") == "tab" and n.attrs.get("aria-controls")]
        labels = {t.attrs["aria-controls"]: t.text().strip() for t in tabs}
        for panel in panels:
            put(panel, labels.get(panel.attrs.get("id", ""), ""))


def find_content(root: Node) -> Node | None:
    """The first place, in order of preference, that has text or an image."""
    for place in CONTENT_PLACES:
        for n in root.walk():
            if _is(n, place) and (n.text().strip() or any(x.tag == "img" for x in n.walk())):
                return n
    return None


def markdown(node: Node, assets: dict[str, str] | None = None) -> str:
    """ATX headings, ``-`` bullets, links, images, emphasis, code, quotes, rules and tables. Hidden parts stay;
    the label of a tab pane comes before it as a heading.

    Inner items and quotes are rendered before outer ones, so that nesting needs no recursion.
    """
    inner: dict[int, str] = {}
    for n in reversed(list(node.walk())):
        if n is not node and n.tag in ("li", "blockquote"):
            inner[id(n)] = _markdown(n, assets or {}, inner)
    return _markdown(node, assets or {}, inner)


def _markdown(node: Node, assets: dict[str, str], inner: dict[int, str]) -> str:
    """Markdown of a node, given that of the items and quotes in it."""
    out: list[str] = []

    def inline(x) -> str:
        if isinstance(x, str):
            return one(x, {})
        said: dict[int, str] = {}
        for n in reversed(list(x.walk())):
            said[id(n)] = one(n, said)
        return said[id(x)]

    def one(x, said: dict[int, str]) -> str:
        if isinstance(x, str):
            return " ".join(x.split()) if x.strip() else (" " if x else "")
        if x.tag in RAW:
            return ""
        if x.tag == "br":
            return "\n"
        if x.tag == "img":
            src = x.attrs.get("src", "")
            return f"![{x.attrs.get('alt', '')}]({assets.get(src, src)})"
        body = _joined(x.kids, lambda k: one(k, said) if isinstance(k, str) else said[id(k)])
        t = body.strip()
        if x.tag in ("b", "strong") and t:
            return f"**{t}**"
        if x.tag in ("i", "em") and t:
            return f"*{t}*"
        if x.tag == "code" and t:
            return f"`{t}`"
        if x.tag == "a" and x.attrs.get("href") and t:
            h = x.attrs["href"]
            return f"[{t}]({assets.get(h, h)})"
        return body

    def flush(run: list) -> None:
        t = _joined(run, inline).strip()
        if t:
            out.append(t + "\n\n")
        run.clear()

    def emit(x) -> None:
        todo: list = [(iter(x.kids), [])]
        while todo:
            kids, run = todo[-1]
            for k in kids:
                if isinstance(k, str) or (k.tag not in BLOCKS and k.tag not in ("li", "tr", "td", "th", "details", "summary", "body", "html", "tbody", "thead", "main", "figure")):
                    run.append(k)
                    continue
                flush(run)
                if k.tag in RAW:
                    continue
                label = k.attrs.get("data-pane-label") or k.attrs.get("data-label")
                if label:
                    out.append(f"#### Aba: {label}\n\n")
                if len(k.tag) == 2 and k.tag[0] == "h" and k.tag[1].isdigit():
                    t = _joined(k.kids, inline).strip()
                    if t:
                        out.append("#" * int(k.tag[1]) + f" {t}\n\n")
                elif k.tag == "hr":
                    out.append("---\n\n")
                elif k.tag == "pre":
                    out.append(f"```\n{k.text().strip(chr(10))}\n```\n\n")
                elif k.tag in ("ul", "ol"):
                    n = 0
                    for li in (y for y in k.kids if isinstance(y, Node) and y.tag == "li"):
                        n += 1
                        mark = "-" if k.tag == "ul" else f"{n}."
                        t = inner[id(li)].strip().replace("\n", "\n  ")
                        out.append(f"{mark} {t}\n")
                    out.append("\n")
                elif k.tag == "table":
                    rows = [[" ".join(c.text().split()) for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in k.walk() if r.tag == "tr"]
                    rows = [r for r in rows if r]
                    for i, r in enumerate(rows):
                        out.append("| " + " | ".join(r) + " |\n")
                        if i == 0:
                            out.append("| " + " | ".join("---" for _ in r) + " |\n")
                    out.append("\n")
                elif k.tag == "blockquote":
                    out.append("> " + inner[id(k)].strip().replace("\n", "\n> ") + "\n\n")
                else:
                    todo.append((iter(k.kids), []))  # no recursion: blocks nest as deep as they like
                    break
            else:
                flush(run)
                todo.pop()

    emit(node)
    text = "".join(out)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip()


def _joined(kids, inline) -> str:
    out = ""
    for k in kids:
        s = inline(k)
        if isinstance(k, str) and k.strip():
            s = (" " if k[0].isspace() else "") + s + (" " if k[-1].isspace() else "")
        out += s.lstrip(" ") if out.endswith((" ", "\n")) or not out else s
    return out


def _inner(n: Node) -> str:
    from html import escape

    out: list[str] = []
    todo: list = list(reversed(n.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(x if n.tag in RAW else escape(x, quote=False))
        else:
            out.append(f"<{x.tag}{''.join(f' {k}={chr(34)}{escape(v)}{chr(34)}' for k, v in x.attrs.items())}>")
            if x.tag not in VOID:
                todo.append((f"</{x.tag}>",))
                todo += reversed(x.kids)
    return "".join(out)


@F.pandas_udf(T.StringType())
def basic_references(html: pd.Series) -> pd.Series:
    """Pages in which a parser decodes &quot; &lt; &gt; and &amp, with or without its semicolon; other references are text."""
    return html.map(lambda h: None if h is None else NO_BASIC_REFERENCE.sub(lambda m: m[1] or "&amp;", h))


@F.pandas_udf(T.StringType())
def main_content(html: pd.Series) -> pd.Series:
    """Inner HTML of the page's content; null if none is found."""

    def one(h):
        n = find_content(parse(h))
        return None if n is None else _inner(n)

    return html.map(one)


@F.pandas_udf(T.StringType())
def content_markdown(html: pd.Series) -> pd.Series:
    def one(h):
        root = parse(h)
        reveal(root)
        n = find_content(root)
        return None if n is None else markdown(n)

    return html.map(one)


TITLE = r"(?is)<title[^>]*>(.*?)</title>"


# References that titles hold, & last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def title(html: Column) -> Column:
    t = F.regexp_extract(html, TITLE, 1)
    for a, b in REFERENCES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href) of the links of a page, scripts and styles left out."""
    clean = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    found = F.regexp_extract_all(clean, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("ord", "href"))


def link_counts(pages: DataFrame) -> DataFrame:
    each = links(pages).where(urls.is_page_href(F.col("href"))).groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"))
    return pages.select("page_id").join(each, "page_id", "left").fillna(0)


def _first(root: Node, place: str) -> Node | None:
    """The first node at a place; a place may be inside another one."""
    for part in place.split():
        root = next((n for n in root.walk() if n is not root and _is(n, part)), None)
        if root is None:
            return None
    return root


def _own_item(n: Node | None) -> Node | None:
    while n is not None and n.tag != "li":
        n = n.up
    return n


def child_hrefs(html: str | None, url: str | None) -> list[str]:
    """Links in the page's own item of a page tree, else those of its list of children.

    The item is the one around the node with the page id of the page's meta element, in the first tree that has such a
    node; if there is none, or if it lies in no item, the one around a tree's first link to the page, in either display
    form, in the first tree where that lies in an item. Each href comes once, in page order; links to the page itself don't count.
    """
    root, url = parse(html), url or ""
    plain = lambda h: urldefrag(urljoin(url, h))[0]
    where = urlsplit(url)
    mine = {plain(url)}
    if where.path.startswith("/display/public/"):
        mine.add(plain(url.replace("/display/public/", "/display/", 1)))
    elif where.path.startswith("/display/"):
        mine.add(plain(url.replace("/display/", "/display/public/", 1)))
    links_of = lambda n: [a.attrs["href"] for a in n.walk() if a.tag == "a" and a.attrs.get("href")]
    trees = [t for t in (_first(root, place) for place in TREE_ROOTS) if t is not None]
    pid = next((n.attrs.get("content") for n in root.walk() if n.tag == "meta" and n.attrs.get("name") == "ajs-page-id"), None)
    inside = lambda t, fits: next((n for n in t.walk() if n is not t and fits(n)), None)
    by_id = next(filter(None, (inside(t, lambda n: n.attrs.get("data-page-id") == pid) for t in trees)), None) if pid else None
    by_link = (inside(t, lambda n: n.tag == "a" and n.attrs.get("href") and plain(n.attrs["href"]) in mine) for t in trees)
    item = _own_item(by_id) or next(filter(None, map(_own_item, by_link)), None)
    if item is not None:
        inner = [h for h in links_of(item) if plain(h) not in mine]
        if inner:
            return list(dict.fromkeys(inner))
    at = lambda places: [n for n in root.walk() if any(_is(n, p) for p in places)]
    if any(links_of(n) for n in at(CHILD_SECTIONS)):
        return list(dict.fromkeys(h for n in at(TAKEN_SECTIONS) for h in links_of(n)))
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tree_children(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([child_hrefs(h, u) for h, u in zip(html, url, strict=True)])


def tree_children(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, ord, href) of each page's children."""
    return pages.select("page_id", F.posexplode(_tree_children("html", "url")).alias("ord", "href"))


def asset_names(assets: DataFrame) -> DataFrame:
    """assets(page_id, title, url) -> local names: slug of the stem, extension up to ten characters, -n when
    the name is taken in the page; a URL that repeats keeps its name."""
    base = F.element_at(F.split(urls.path(F.col("url")), "/"), -1)
    ext = F.substring(F.regexp_extract(base, r"(\.[^.]*)$", 1), 1, 10)
    one = assets.groupBy("page_id", "title", "url").agg(F.min("ord").alias("ord"))
    one = one.withColumn("__s", slug(F.regexp_replace(base, r"\.[^.]*$", ""))).withColumn("__e", ext)
    nth = F.row_number().over(Window.partitionBy("page_id", "__s", "__e").orderBy("ord"))
    name = F.concat("__s", F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""), "__e")
    return one.select("page_id", "ord", "url", F.concat(F.lit("../attachments/"), slug(F.col("title")), F.lit("/"), name).alias("local"))
