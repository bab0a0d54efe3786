"""Pages as Markdown whose images and attachments point to local copies.

A page names its assets, the stored downloads say which of their addresses were fetched, and the join of the two comes
back to the page as one short list; only then the page is rendered, with its addresses replaced. An address on very
many pages meets its one row of the downloads in a join that adaptive execution can split.
"""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slug
from ..session import ship
from .html import Node, find_content, markdown, parse, reveal

# What marks the address of an attachment, links that are none, the largest asset that is kept.
ATTACHMENT_HINTS = ("/download/attachments/", "/download/thumbnails/", "/rest/api/content/")
SKIPPED_LINKS = ("mailto:", "javascript:", "#")
MOST_BYTES = 25 << 20
_TEXTS = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
REFERENCES = T.ArrayType(_TEXTS("url", "stem", "ext"))
RENDERED = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("assets", T.ArrayType(_TEXTS("url", "local")))])


def _content(html: str | None) -> Node | None:
    root = parse(html)
    reveal(root)
    return find_content(root)


def references(content: Node | None) -> list[tuple[Node, str, str]]:
    """(node, attribute, address) of images, then of attachments, in page order."""
    if content is None:
        return []
    nodes = list(content.walk())
    images = [(n, "src", n.attrs["src"]) for n in nodes if n.tag == "img" and n.attrs.get("src")]
    hrefs = [(n, "href", n.attrs["href"]) for n in nodes if n.tag == "a" and n.attrs.get("href")]
    return images + [x for x in hrefs if not x[2].startswith(SKIPPED_LINKS) and any(h in x[2] for h in ATTACHMENT_HINTS)]


def _absolute(base: str | None, address: str) -> str | None:
    try:
        url = urljoin(base or "", address)
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


@F.pandas_udf(REFERENCES)
def _referenced(html: pd.Series, url: pd.Series) -> pd.Series:
    def one(h, base):
        every = dict.fromkeys(a for _, _, x in references(_content(h)) if (a := _absolute(base, x)))
        names = {a: PurePosixPath(PurePosixPath(urlsplit(a).path).name or "asset") for a in every}
        return [{"url": a, "stem": p.stem, "ext": p.suffix[:10]} for a, p in names.items()]

    return pd.Series([one(h, u) for h, u in zip(html, url, strict=True)])


def localise(content: Node, base: str | None, folder: str, known: dict[str, tuple[str, str, bool]]) -> list[tuple[str, str]]:
    """Replace the addresses of content's assets; known: slug of the stem, extension and whether it was fetched, by
    address. Returns (address, local path) of those replaced.

    Names are given in the order of references, ``-n`` being the first free one from 2 on; an address that wasn't fetched
    stays, and takes a name each time it is met.
    """
    used: set[str] = set()
    local: dict[str, str] = {}
    for node, attribute, address in references(content):
        url = _absolute(base, address)
        if url is None:
            continue
        stem, ext, fetched = known[url]
        if url not in local:
            name, n = f"{stem}{ext}", 2
            while name in used and n <= 100:
                name, n = f"{stem}-{n}{ext}", n + 1
            used.add(name)
            if not fetched:
                continue
            local[url] = f"../attachments/{folder}/{name}"
        node.attrs[attribute] = local[url]
        if attribute == "src":
            node.attrs.pop("srcset", None)
    return list(local.items())


@F.pandas_udf(RENDERED)
def _rendered(html: pd.Series, url: pd.Series, folder: pd.Series, known: pd.Series) -> pd.DataFrame:
    out = []
    for h, u, f, k in zip(html, url, folder, known, strict=True):
        content = _content(h)
        if content is None:
            out.append((None, []))
            continue
        assets = localise(content, u, f, {x["url"]: (x["stem"], x["ext"], x["fetched"]) for x in (k if k is not None else ())})
        out.append((markdown(content), [{"url": a, "local": b} for a, b in assets]))
    return pd.DataFrame(out, columns=["markdown", "assets"])


def localised(pages: DataFrame, downloads: DataFrame) -> DataFrame:
    """pages(page_id, title, url, html), downloads(url, ok, bytes) -> (page_id, markdown, assets): the body of each page.

    markdown is null for a page without content; assets has the addresses that were replaced and where they lie. A
    download that failed or is larger than ``MOST_BYTES`` counts as none; of rows that repeat an address one that was
    fetched is enough. Pages are told apart by page_id, null being one.
    """
    ship(pages.sparkSession)
    refs = pages.select("page_id", F.explode(_referenced("html", "url")).alias("r")).select("page_id", "r.*").distinct()
    fetched = downloads.where(F.col("ok") & (F.coalesce("bytes", F.lit(0)) <= MOST_BYTES)).select(F.col("url").alias("have")).distinct()
    refs = refs.join(fetched, F.col("url") == F.col("have"), "left")
    stem = F.coalesce(F.nullif(slug(F.col("stem")), F.lit("")), F.lit("asset"))
    known = refs.select("page_id", F.struct("url", stem.alias("stem"), "ext", F.col("have").isNotNull().alias("fetched")).alias("r"))
    known = known.groupBy(F.col("page_id").alias("of")).agg(F.collect_list("r").alias("known"))
    both = pages.join(known, F.col("page_id").eqNullSafe(F.col("of")), "left")
    return both.select("page_id", _rendered("html", "url", F.coalesce(slug(F.col("title")), F.lit("")), "known").alias("m")).select("page_id", "m.*")
