import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from pagegraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def table(rows, names):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(value(r[i]) for i in at) for r in rows), key=key)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_its_sql(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    cur = con.execute(entry.oracle_sql()[name])
    assert table(df.collect(), df.columns) == table(cur.fetchall(), [d[0] for d in cur.description])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_other_queries_have_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_display_formats_keep_large_and_slow_pages(spark, tmp_path):
    sizes = [50, 6_000, 359_999, 360_000, 1_048_576, 5_000_000]
    rows = [(k * 10, f"https://h.example/en/p{k}", "x" * n) for k, n in enumerate(sizes)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["filename"]: (r["size"], r["took"]) for r in catalogue.display_formats(spark, str(tmp_path)).collect()}
    want = {}
    for (i, _, html), n in zip(rows, sizes, strict=True):
        s, m = n / 100, n // 100 // 60
        size = f"{n:.1f} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB"
        took = f"{s:.1f}s" if s < 60 else f"{m}min {n // 100 % 60}s" if m < 60 else f"{m // 60}h {m % 60}min {n // 100 % 60}s"
        want[f"{i:04d}-page.pdf"] = size, took
    assert got == want


TITLES = ["a@mail.example", "C++ and C#", "x &quot;y&quot; &amp; z", "Café ™ ®", "", "@@", "a  b\t c", "q" * 90, "&lt;p&gt;", "A&B/C_d-e"]


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """Pages with symbols and references in their titles, without a title or html, and with one title 120 times."""
    at = str(tmp_path_factory.mktemp("odd"))
    html = [f"<head><title>{t}</title></head>" for t in TITLES] + ["<p>none</p>", None]
    rows = [(k, f"https://h.example/en/p{k}", h) for k, h in enumerate(html)] + [(50 * k + 49, f"https://h.example/en/s{k}", "<title>Same @ title</title>") for k in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def against_sql(spark, at, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/pages.parquet/*.parquet')")
    cur = c.execute(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, at)
    return table(df.collect(), df.columns), table(cur.fetchall(), [d[0] for d in cur.description])


def test_file_names_of_odd_titles(spark, odd_pages):
    got, want = against_sql(spark, odd_pages, "page_filename")
    assert got == want


def test_slugs_of_odd_titles(spark, odd_pages):
    got, want = against_sql(spark, odd_pages, "page_title_slug")
    assert got == want


def test_bookmarks_of_odd_titles(spark, odd_pages):
    """Beside page 3, whose title has signs that bookmarks spell out and the SQL does not."""
    got, want = against_sql(spark, odd_pages, "bookmark_titles")
    assert got[0] == want[0] == ["bookmark", "page_id"]
    assert [r for r in got[1] if r[1] != 3] == [r for r in want[1] if r[1] != 3]


def test_contents_lines_of_odd_titles(spark, odd_pages):
    """Beside page 11, which has no html: the SQL has no line for it, the contents one without a title."""
    got, want = against_sql(spark, odd_pages, "markdown_consolidated_toc")
    assert got[0] == want[0] == ["idx", "line"]
    assert [r for r in got[1] if r[0] != 11] == [r for r in want[1] if r[0] != 11]


HEADS = ["x = &quot", "x &lt", "x &gt", "x &nbsp;y&copy z", "x&#39;s &#x27;y&#39", "&AMP; &QUOT;", "&amp", "&ampq &amp;lt; &lt;b&gt;", "&am", "AT&T & q", "\tt\n v"]


@pytest.fixture(scope="module")
def odd_articles(spark, tmp_path_factory):
    """Pages with references cut short and with ones that the SQL does not decode, without an article or html."""
    at = str(tmp_path_factory.mktemp("odd"))
    html = [f"<head><title>{t}</title><script>a && b</script></head><!-- & --><article><h1>{t}</h1><p>{t}.</p><p><b>{t.strip()} y<br></article>" for t in HEADS]
    rows = [(k, f"https://h.example/en/p{k}", h) for k, h in enumerate([*html, "<p>none &copy</p>", None])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def test_local_copies_of_odd_references(spark, odd_articles):
    got, want = against_sql(spark, odd_articles, "localised_markdown")
    assert got == want


def test_document_of_odd_references(spark, odd_articles):
    got, want = against_sql(spark, odd_articles, "markdown_document")
    assert got == want


def test_content_of_odd_references(spark, odd_articles):
    got, want = against_sql(spark, odd_articles, "page_main_content")
    assert got == want


def test_markdown_of_odd_references(spark, odd_articles):
    got, want = against_sql(spark, odd_articles, "page_markdown")
    assert got == want
