from pagegraph.operators import assets, html


def test_names_are_unique_in_a_page_and_failures_take_one():
    page = '<article><img src="/a.png"><img src="/x/a.png"><img src="/y/a-2.png"><img src="/bad/a.png"><img src="/bad/a.png"><img src="/z/a.png"><img src="/a.png" srcset="/b.png 2x">' + '<a href="/download/attachments/1/r.pdf">r</a><a href="#/download/attachments/1">no</a><a href="/plain">no</a><a href="ftp://h/download/attachments/q">no</a></article>'
    content = html.find_content(html.parse(page))
    known = {assets._absolute("https://h/p", x): ("a-2" if "a-2" in x else "r" if "r.pdf" in x else "a", ".pdf" if "pdf" in x else ".png", "/bad/" not in x) for _, _, x in assets.references(content) if assets._absolute("https://h/p", x)}
    got = assets.localise(content, "https://h/p", "page", known)
    assert [b.rpartition("/")[2] for _, b in got] == ["a.png", "a-2.png", "a-2-2.png", "a-5.png", "r.pdf"]
    src = [n.attrs["src"] for n in content.walk() if n.tag == "img"]
    assert src[3] == src[4] == "/bad/a.png" and src[6] == src[0] == "../attachments/page/a.png"
    assert not any("srcset" in n.attrs for n in content.walk())


def test_pages_without_content_assets_or_id(spark):
    rows = [(1, "T", "https://h/p", "<p>no place</p>"), (2, "T", "https://h/p", "<article>text</article>"), (None, "T", "https://h/p", '<article><img src="i.png"></article>'), (4, None, None, '<article>x<img src="https://h/i.png"></article>'), (5, "T", "u", None), (6, "T", "https://h/p", '<article>y<img src="http://[bad"></article>')]
    pages = spark.createDataFrame(rows, "page_id long, title string, url string, html string")
    downloads = spark.createDataFrame([("https://h/i.png", True, 5), ("https://h/i.png", False, 5)], "url string, ok boolean, bytes long")
    got = {r["page_id"]: (r["markdown"], len(r["assets"])) for r in assets.localised(pages, downloads).collect()}
    assert got == {1: (None, 0), 2: ("text", 0), None: ("![](../attachments/t/i.png)", 1), 4: ("x![](../attachments//i.png)", 1), 5: (None, 0), 6: ("y![](http://[bad)", 0)}
    assert assets.localised(pages.where("false"), downloads).count() == 0
    assert assets.localised(pages, downloads.where("false")).where("size(assets) > 0").count() == 0


def test_tab_panes_get_their_labels():
    tabs = '<div class="aui-tabs"><ul class="tabs-menu"><li class="menu-item">One</li><li>  Two </li><li></li></ul><div class="tabs-pane" style="display:none"><p>first</p></div><div class="tab-pane"><p>second</p></div><div class="tab-pane"><p>third</p></div><div class="tab-pane">fourth</div></div>'
    got = html.markdown(_content(tabs))
    assert "#### Aba: One\n\nfirst" in got and "#### Aba: Two\n\nsecond" in got and "third" in got and "fourth" in got and got.count("Aba:") == 2
    roles = '<div role="tablist"><button role="tab" aria-controls="p2">B</button><button role="tab" aria-controls="p1">A</button><button role="tab">C</button></div><div role="tabpanel" id="p1" hidden><p>pane a</p></div><div role="tabpanel" id="p2"><p>pane b</p></div><div role="tabpanel"><p>pane c</p></div>'
    got = html.markdown(_content(roles))
    assert "#### Aba: A\n\npane a" in got and "#### Aba: B\n\npane b" in got and got.count("Aba:") == 2
    nested = '<div class="aui-tabs"><ul class="tabs-menu"><li>Out</li></ul><div class="tabs-pane"><div class="aui-tabs"><ul class="tabs-menu"><li>In</li></ul><div class="tabs-pane">deep</div></div></div></div>'
    got = html.markdown(_content(nested))
    assert "#### Aba: Out" in got and "#### Aba: In\n\ndeep" in got


def test_details_are_open():
    got = html.markdown(_content('<details><summary>More</summary><p>hidden text</p><div class="expand-content" style="display:none">folded</div></details>'))
    assert "More" in got and "hidden text" in got and "folded" in got


def _content(inside):
    root = html.parse(f"<article>{inside}</article>")
    html.reveal(root)
    return html.find_content(root)
