import pytest
from pyspark.sql import functions as F

from pagegraph.functions import classify as c
from pagegraph.functions import text as t
from pagegraph.session import ship


@pytest.fixture(scope="module")
def one(spark):
    ship(spark)
    return lambda value, f, kind="string": spark.createDataFrame([(value,)], f"u {kind}").select(f(F.col("u")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("title", "want"),
    [("Configurações de Sistema", "configuracoes-de-sistema"), ("Foo & Bar", "foo-and-bar"), ("con", "con-page"), ("NUL", "nul-page"), ("a/b: c?", "a-b-c"), ("C++ e C#", "c-plus-plus-e-c-sharp"), ("ﬁ ½", "fi-12"), ("x​y", "xy")],
)
def test_slug(one, title, want):
    assert one(title, t.slug) == want


def test_slug_of_other_scripts_and_long_titles(one):
    assert len(one("中文页面", t.slug)) == len("pagina-") + 8
    assert len(one("a" * 200, t.slug)) == 80


@pytest.mark.parametrize(("n", "want"), [(0, "0.0 B"), (123456, "120.6 KB"), (1024**3, "1.0 GB"), (5 * 1024**4, "5.0 TB"), (1280, "1.2 KB")])
def test_bytes(one, n, want):
    assert one(n, t.format_bytes, "long") == want


@pytest.mark.parametrize(("s", "want"), [(5.25, "5.2s"), (82.5, "1min 22s"), (7250.0, "2h 0min 50s")])
def test_duration(one, s, want):
    assert one(s, t.format_duration, "double") == want


def test_names(spark):
    df = spark.createDataFrame([(1, "Pagina A", 1), (1, "Pagina A", 2), (1, "Pagina A", 100)], "i int, title string, nth int")
    got = [r[0] for r in df.select(t.file_name(t.file_base(F.col("i"), F.lit("pagina-a")), F.col("nth"), F.col("i"), F.col("title"))).collect()]
    assert got[:2] == ["0001-pagina-a.pdf", "0001-pagina-a-2.pdf"] and len(got[2]) == len("0001-pagina-a-12345678.pdf")


def kind(spark, status, title="", body="", mitigated=None, is_page=False):
    df = spark.createDataFrame([(status, mitigated, title, body, is_page)], "s int, m string, t string, b string, p boolean")
    return df.select(c.page_kind(*map(F.col, "smtbp"))).first()[0]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ({"status": 429}, "rate-limit"), ({"status": 200, "title": "Access denied | h used Cloudflare", "body": "Error 1015"}, "rate-limit"), ({"status": 200, "body": "Ray ID: 1", "is_page": True}, None),
        ({"status": 503, "mitigated": "challenge"}, "challenge"), ({"status": 403, "title": "Just a moment..."}, "challenge"), ({"status": 403, "title": "Attention | Cloudflare", "body": "Sorry, you have been blocked"}, "access-denied"),
        ({"status": 522}, "server-error"), ({"status": 403, "body": "restricted"}, None), ({"status": 404}, None), ({"status": None}, None),
    ],
)
def test_response_kind(spark, args, want):
    assert kind(spark, **args) == want


@pytest.mark.parametrize(("v", "want"), [("42", 42.0), (" 3583 ", 3583.0), ("0", 0.0), ("abc", None), ("-1", None), ("999999", None), (None, None), ("", None), ("Wed, 21 Oct 2015 07:28:10 GMT", 10.0)])
def test_retry_after(one, v, want):
    assert one(v, lambda x: c.retry_after(x, F.lit(1445412480.0))) == want


@pytest.mark.parametrize(
    ("e", "want"),
    [("HTTP 522 from server", True), ("net::ERR_TIMED_OUT", True), ("429 Too Many Requests", True), ("pageId=1785936503", False), ("5039 tentativas", False), ("x\nCall log: 503", False), ("at https://h.example/Registro+C503 x", False)],
)
def test_blocking(one, e, want):
    assert one(e, c.is_blocking) is want


def test_errors(one):
    assert one("net::ERR_PROXY_CONNECTION_FAILED", c.is_passing) and one("net::ERR_PROXY_CONNECTION_FAILED", c.is_exit_error)
    assert one("socket hang up", c.is_passing) and not one("socket hang up", c.is_exit_error)
    assert one("x" * 400, c.short_error) == "x" * 297 + "..."
    assert one("see https://a.b/C503 NOW\nCall log:\n1", c.headline) == "see <url> now"
    assert one("Wed, 21 Oct 2015 07:28:10 GMT", c.http_date_seconds) == 1445412490.0


@pytest.mark.parametrize(("p", "want"), [("pages/a.pdf", None), ("../a", "traversal"), ("a/../../b", "traversal"), ("/etc", "traversal"), ("a\\..\\b", "traversal"), ("x" * 241, "too long"), ("a..b/c", None)])
def test_paths(one, p, want):
    assert one(p, t.path_problem) == want


def test_what_resumes_a_run(spark):
    rows = [(False, False), (True, False), (False, True), (True, True)]
    df = spark.createDataFrame(rows, "update boolean, again boolean")
    assert [r[0] for r in df.select(c.resume_mode(F.col("update"), F.col("again"))).collect()] == ["auto", "update", "regenerate", "regenerate"]
