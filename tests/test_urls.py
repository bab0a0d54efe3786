import pytest
from pyspark.sql import functions as F

from pagegraph.functions import urls
from pagegraph.session import ship

B = "https://h.example/display/public/PROT/A+B"


@pytest.fixture(scope="module")
def one(spark):
    ship(spark)
    return lambda value, f: spark.createDataFrame([(value,)], "u string").select(f(F.col("u")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://h.example/y#section", "https://h.example/y"),
        ("https://h.example/y?pageId=123&foo=bar&spaceKey=PROT", "https://h.example/y?pageId=123&spaceKey=PROT"),
        ("https://H.example//a//b?src=x&pageId=3&title=A+B#f", "https://H.example/a/b?pageId=3&title=A B"),
        ("  HTTPS://h.example ", "https://h.example/"),
        ("https://h.example/x?title=b&title=a&pageId=", "https://h.example/x?pageId=&title=a&title=b"),
        ("https://h.example/x?title=A%26B", "https://h.example/x?title=A&B"),
        ("https://h.example/x?title=%zz", "https://h.example/x?title=%zz"),
    ],
)
def test_canonical(one, url, want):
    assert one(url, urls.canonical) == want


def test_variant(one):
    assert one(B, urls.display_variant) == "https://h.example/display/PROT/A+B"
    assert one("https://h.example/display/PROT/A+B?x=1#f", urls.display_variant) == "https://h.example/display/public/PROT/A+B?x=1#f"
    assert one("https://h.example/pages/viewpage.action?pageId=1", urls.display_variant) is None


@pytest.mark.parametrize("url", [B + "/", B.replace("/public", ""), B.replace("https", "http"), B.replace("h.example", "H.EXAMPLE"), B + "?src=sidebar"])
def test_start_key_is_the_same(one, url):
    assert one(url, urls.start_url_key) == one(B, urls.start_url_key) == "h.example/display/PROT/A+B?"
    assert one(B + "2", urls.start_url_key) != one(B, urls.start_url_key)


@pytest.mark.parametrize(
    ("url", "prefix", "key"),
    [("https://H.example/display/PROT/Pagina+Inicial", "/display/PROT/", "PROT"), (B, "/display/public/PROT/", "PROT"), ("https://h.example/spaces/K/x", "/spaces/K/", "K"), ("https://h.example/x", "/", None)],
)
def test_scope(one, url, prefix, key):
    s = one(url, urls.scope)
    assert (s["domain"], s["path_prefix"], s["space_key"]) == ("h.example", prefix, key)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (B, True), ("https://h.example/display/PROT/x", True), ("https://h.example/pages/viewpage.action?pageId=2", True), ("https://h.example/pages/editpage.action?pageId=2", False),
        ("https://h.example/any?spaceKey=PROT", True), ("https://other.example/display/public/PROT/x", False), ("ftp://h.example/display/public/PROT/x", False), ("https://h.example/display/OTHER/x", False),
    ],
)
def test_in_scope(one, url, want):
    assert one(url, lambda u: urls.in_scope(u, F.lit("h.example"), F.lit("/display/public/PROT/"), F.lit("PROT"))) is want


@pytest.mark.parametrize(("h", "want"), [("0x7f000001", "127.0.0.1"), ("2130706433", "127.0.0.1"), ("017700000001", "127.0.0.1"), ("h.example", "h.example"), ("99999999999", "99999999999")])
def test_ipv4(one, h, want):
    assert one(h, urls.ipv4_from_number) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://h.example/x", None), ("", "empty"), ("file:///x", "scheme"), ("http://localhost/", "blocked host"), ("http://0x7f000001/", "blocked host"), ("http://[fe80::1]/", "blocked host"), ("http://10.1.2.3:80/", "blocked host"), ("http://169.254.169.254/", "blocked host")],
)
def test_start_url(one, url, want):
    assert one(url, urls.start_url_problem) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("h:3128", "http://h:3128"), ("socks5h://h", "socks5://h:1080"), ("h:8080:u:p", "http://u:p@h:8080"), ("socks5://u:p@h", None), ("http://h:0", None), ("direct", None), ("", None), ("gopher://h", None)],
)
def test_exit_url(one, raw, want):
    assert one(raw, urls.exit_url) == want


def test_small_ones(one):
    assert one("https://h.example/x?pageId=12&pageId=3", urls.page_id) == "12"
    assert one("https://h.example/x?pageId=1a", urls.page_id) is None
    assert one("https://h.example/display/K/x", lambda u: urls.match_form(u, F.lit(True))) == "https://h.example/display/public/K/x"
    assert one("javascript:x()", urls.is_page_href) is False
    assert one("http://u:p@h:1", urls.masked_exit) == "http://***:***@h:1"
