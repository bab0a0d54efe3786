import re
from html import unescape

import pytest

from pagegraph.llm import html_density as h

from .conftest import data, sentence

PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style></head><body>{top}<div id="wrap">{before}<{tag}>
<h1>Head &amp; line</h1><p>First  para<b>graph</b> is here, with<br>some words.<p>Second one &lt;tag&gt; &eacute;.</p><ul><li>item one<li>item two</ul></{tag}>{after}</div>{end}</body></html>"""
TEXT = "Head & line\nFirst paragraph is here, with some words.\nSecond one <tag> é.\nitem one\nitem two"
BOILER = {
    "top": ['<header><a href="/">Site</a><p>Slogan of the site</p></header>', '<nav><ul><li><a href="/a">A</a></li></ul></nav>', '<div class="cookie-notice">We use cookies on this site, read more about them here.</div>', ""],
    "before": ['<aside><p>Side bar text, of some length.</p></aside>', '<div class="ad">Buy this thing now, it is very good and cheap.</div>', "", '<div id="sidebar"><p>links</p></div>'],
    "after": ['<section class="comments"><p>A reader says that this is a very long comment, longer than much else.</p></section>', '<form><label>Mail</label><input name="q"></form>', '<div class="related-posts"><a href="/x">Other</a></div>', ""],
    "end": ["<footer>&copy; site &middot; all rights</footer>", '<script>var t = "</p><p>not text</p>";</script>', "<!-- gone --><div role='contentinfo'>x</div>", ""],
}


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
@pytest.mark.parametrize("k", range(4))
@pytest.mark.parametrize("j", range(4))
def test_article_without_boilerplate(tag, k, j):
    parts = {n: v[(k + i * j) % 4] for i, (n, v) in enumerate(BOILER.items())}
    page = PAGE
    for n, v in {**parts, "tag": tag}.items():
        page = page.replace("{" + n + "}", v)
    assert h.main_text(page) == TEXT


@pytest.mark.parametrize("html", [None, "", "<html></html>", "<body><nav>only a menu</nav></body>", "<script>x", "<!-- only", "<", "<p"])
def test_nothing_to_extract(html):
    assert h.main_text(html) in ("", "<", "<p")


def test_deep_and_long_pages():
    deep = "<body>" + "<div>" * 3000 + "<p>" + "text " * 50 + "</p><p>more</p>" + "</div>" * 3000 + "</body>"
    assert h.main_text(deep) == ("text " * 50).strip() + "\nmore"
    long = "<body><article>" + "".join(f"<p>paragraph {i} of many</p>" for i in range(5000)) + "</article></body>"
    assert h.main_text(long).count("\n") == 4999


def para(k, n=45):
    return sentence(300 + k, n) + "."


def p_of(*ks, n=45):
    return "".join(f"<p>{para(k, n)}</p>" for k in ks)


def menu(k, n=6):
    return "".join(f'<li><a href="/{k}{i}">{sentence(900 + 7 * k + i, 2)}</a></li>' for i in range(n))


def rows_of_links(k, n=6):
    return "".join(f'<div><a href="/{k}{i}">{sentence(950 + 7 * k + i, 4)}</a> {i} days ago</div>' for i in range(n))


#: Pages without <article>, <main> or telling names: (html of the body, lines of the text).
FORMS = {
    "menu and foot": (f"<div><ul>{menu(1)}</ul></div><div><h1>Title of it</h1>{p_of(1, 2, 3)}</div><div>Made in 2020 <a href='/c'>contact</a> <a href='/d'>imprint</a></div>", ["Title of it", para(1), para(2), para(3)]),
    "table layout": (f"<table><tr><td><ul>{menu(2)}</ul></td><td><h1>Head</h1>{p_of(4, 5, 6)}</td><td>{rows_of_links(2)}</td></tr></table>", ["Head", para(4), para(5), para(6)]),
    "title beside the block": (f"<div><h1>Lone title</h1><div>{p_of(7, 8, 9, 10)}</div><div>{rows_of_links(3, 9)}</div></div>", ["Lone title", para(7), para(8), para(9), para(10)]),
    "two blocks": (f"<div><ul>{menu(4, 12)}</ul></div><div><div>{p_of(11, 12, 13)}</div><div>{p_of(14, 15)}</div></div><div>{rows_of_links(4, 8)}</div>", [para(k) for k in range(11, 16)]),
    "sections": (f"<div>{rows_of_links(5)}</div><div><section><h2>One</h2>{p_of(16, 17, 18, 19)}</section><section><h2>Two</h2>{p_of(20)}</section><section><h2>Three</h2><p>A short end.</p></section></div>", ["One", *(para(k) for k in range(16, 20)), "Two", para(20), "Three", "A short end."]),
    "latest posts": (f"<div><h1>Post</h1>{p_of(21, 22)}<ul><li>first point</li><li>second point</li></ul>{p_of(23)}</div><div><h3>Latest</h3>{rows_of_links(6, 10)}</div>", ["Post", para(21), para(22), "first point", "second point", para(23)]),
    "cloud of tags": (f"<div>{p_of(24, 25, 26)}</div><div>Tags: " + " ".join(f"<a href='/t{i}'>{w}</a>" for i, w in enumerate(sentence(77, 40).split())) + "</div>", [para(24), para(25), para(26)]),
    "user line": (f"<div><span>Hello guest</span> <a href='/l'>log on</a> <a href='/r'>register</a> <a href='/h'>help</a></div><div><div><div>{p_of(27, 28, 29)}<blockquote>{para(30)}</blockquote>{p_of(31)}</div></div></div>", [para(27), para(28), para(29), para(30), para(31)]),
    "links in the text": (f"<div><ul>{menu(8, 9)}</ul></div><div>" + p_of(32, 33).replace(para(32), para(32)[:60] + "<a href='/x'>" + para(32)[60:80] + "</a>" + para(32)[80:]) + f"{p_of(34)}</div><div>{rows_of_links(9)}</div>", [para(32), para(33), para(34)]),
}


@pytest.mark.parametrize("form", FORMS)
def test_forms_where_only_density_tells(form, monkeypatch):
    body, lines = FORMS[form]
    page = f"<html><head><title>t</title></head><body>{body}</body></html>"
    assert h.main_text(page) == "\n".join(lines)
    monkeypatch.setattr(h.Page, "content", lambda self: [0])
    assert h.main_text(page) != "\n".join(lines)


def test_the_threshold_decides(monkeypatch):
    page = "<body>" + FORMS["two blocks"][0] + "</body>"
    lines = FORMS["two blocks"][1]
    own = h.Page.threshold
    assert h.main_text(page) == "\n".join(lines)
    monkeypatch.setattr(h.Page, "threshold", lambda self: (own(self)[0], float("inf")))
    assert h.main_text(page) == "\n".join(lines[:3])  # the greatest sum alone
    monkeypatch.setattr(h.Page, "threshold", lambda self: (own(self)[0], 0.0))
    assert h.main_text(page) != "\n".join(lines)  # everything is entered


def test_names_in_the_article_are_no_shears():
    parts = [("div", "class='related-work'"), ("section", "id='search'"), ("section", "id='comments-on-method'"), ("div", "class='section-header'"), ("div", "id='menu-planning'"), ("section", "class='notices-of-the-court'")]
    for tag in ("article", "main", "div"):
        page = f"<body><ul>{menu(1)}</ul><{tag}><h1>Head</h1>" + "".join(f"<{t} {a}>{p_of(40 + 2 * i, 41 + 2 * i)}</{t}>" for i, (t, a) in enumerate(parts)) + f"</{tag}></body>"
        assert h.main_text(page) == "\n".join(["Head", *(para(40 + k) for k in range(12))]), tag
    # what names alone tell: text of its own beside the article, with most of the page's words or not
    for name in ("class='comments'", "id='cookie-notice'", "class='post ad'", "class='sidebar_2'"):
        page = f"<body><div>{p_of(60, 61, 62)}<div {name}>{para(63)} {para(64)}</div></div></body>"
        assert h.main_text(page) == "\n".join(para(k) for k in (60, 61, 62)), name
    # a name of side matter around the whole article doesn't remove it
    assert h.main_text(f"<body><div><ul>{menu(3)}</ul></div><div class='sidebar'>{p_of(65, 66, 67)}</div></body>") == "\n".join(para(k) for k in (65, 66, 67))


def test_densities_against_the_formula():
    import math

    page = h.Page(h.prune(h.parse("<body><div><p>abcdef <a href='/'>gh</a></p><p>ijkl</p></div><p>mn</p></body>")))
    d = {(n.tag, i): page.d[i] for i, n in enumerate(page.order)}
    share = 2 / 14

    def plain(c, lc, t, lt):
        base = max(math.e, math.log(c / max(1, c - lc) * lc + share * c + math.e))
        return c / max(1, t) * math.log(c / max(1, lc) * max(1, t) / max(1, lt), base)

    assert d == pytest.approx({("body", 0): plain(14, 2, 5, 1), ("div", 1): plain(12, 2, 3, 1), ("p", 2): plain(8, 2, 1, 1), ("a", 3): plain(2, 2, 0, 1), ("p", 4): plain(4, 0, 0, 0), ("p", 5): plain(2, 0, 0, 0)})
    assert page.total[1] == pytest.approx(page.d[2] + page.d[4])


def by_regex(html):
    """The stored pages have one form: an article of a heading and paragraphs."""
    a = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:h1|p)>", a)]
    return "\n".join(x for x in parts if x)


def test_every_stored_page(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in h.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == by_regex(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_nulls_repeats_and_clashes(spark):
    rows = [(1, None, None, "x"), (None, "u", "<body><p>a b</p><p>c d</p></body>", "y"), (1, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, data(h.extract(df)))) == sorted(map(str, [(1, None, "", 0), (1, None, "", 0), (None, "u", "a b\nc d", 7)]))
    assert data(h.extract(df.where("false"))) == []


def whole_page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("around", ["article", "section", "div"])
@pytest.mark.parametrize("n", [3, 10, 20, 60])
def test_short_sections_stay_with_their_headings(around, n):
    long, short = sentence(40, 180), sentence(41, n)
    body = f"<{around}><div><h2>First part</h2><p>{long}</p></div><div><h2>Second part</h2><p>{short}</p></div></{around}>"
    assert h.main_text(whole_page(body)) == f"First part\n{long}\nSecond part\n{short}"
    turned = f"<{around}><div><h2>Second part</h2><p>{short}</p></div><div><h2>First part</h2><p>{long}</p></div></{around}>"
    assert h.main_text(whole_page(turned)) == f"Second part\n{short}\nFirst part\n{long}"


def test_a_paragraph_of_links_in_an_article_is_text():
    long = sentence(42, 120)
    links = "".join(f'<a href="/{k}">source {k}</a> ' for k in range(3))
    for at in (f"<p>{long}</p><p>{links}</p>", f"<p>{links}</p><p>{long}</p>"):
        got = h.main_text(whole_page(f"<article><h1>Title</h1>{at}</article>")).split("\n")
        assert got[0] == "Title" and sorted(got[1:]) == sorted([long, "source 0 source 1 source 2"])
    menu = "<ul>" + "".join(f'<li><a href="/{k}">entry {k}</a></li>' for k in range(5)) + "</ul>"
    assert h.main_text(whole_page(f"<article><h1>Title</h1>{menu}<p>{long}</p></article>")) == f"Title\n{long}"


def test_sections_of_other_build_are_no_part_of_the_content():
    long, other = sentence(43, 150), sentence(44, 25)
    links = "".join(f'<li><a href="/{k}">{sentence(50 + k, 6)}</a></li>' for k in range(8))
    for beside in (f'<div class="right"><h3>News</h3><p>{other}</p></div>', f"<div><h4>More</h4><ul>{links}</ul></div>", f"<div><h2>Links only</h2><ul>{links}</ul></div>"):
        got = h.main_text(whole_page(f'<div class="text"><h2>Title</h2><p>{long}</p></div>{beside}'))
        assert got == f"Title\n{long}"


#: Pages without names, roles or elements of HTML for articles and menus: density alone tells their parts apart.
def soup(seed):
    text = [sentence(seed * 10 + k, 60 + 9 * k) for k in range(4)]
    menu = "<div>" + "".join(f'<div><a href="/{k}">{sentence(seed + k, 2)}</a></div>' for k in range(9)) + "</div>"
    teasers = "<div>" + "".join(f'<div><a href="/{k}"><img src="x"><span>{sentence(seed + 30 + k, 8)}</span></a><span>{k}</span></div>' for k in range(6)) + "</div>"
    article = "<div>" + "".join(f"<div>{t}</div>" for t in text) + "</div>"
    return whole_page(f"<div>{menu}<div>{article}</div>{teasers}</div>"), "\n".join(text)


def test_density_alone_decides_on_pages_without_names(monkeypatch):
    pages = [soup(k) for k in range(12)]
    assert [h.main_text(p) for p, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(h.Page, "_density", lambda self, i: 1.0)
    assert all(h.main_text(p) != t for p, t in pages)
