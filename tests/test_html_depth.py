from pagegraph.operators import html


def test_deep_blocks_keep_their_text():
    page = "<div>a" * 3000 + "<p>deepest</p>" + "b</div>" * 3000
    lines = html.markdown(html.parse(page)).split()
    assert lines == ["a"] * 3000 + ["deepest"] + ["b"] * 3000


def test_nested_inline_tags_lists_and_quotes():
    assert html.markdown(html.parse("<b>" * 5000 + "x" + "</b>" * 5000)) == "**" * 5000 + "x" + "**" * 5000
    lines = html.markdown(html.parse("<ul><li>i" * 700 + "</li></ul>" * 700)).split("\n")
    assert [x for x in lines if x.strip()] == ["  " * k + "- i" for k in range(700)]
    assert html.markdown(html.parse("<blockquote>" * 600 + "q" + "</blockquote>" * 600)).count(">") == 600
