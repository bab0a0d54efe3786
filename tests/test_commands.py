import json

import pytest

from pagegraph import commands as c
from pagegraph.sources.manifest import parse_manifests


@pytest.fixture(scope="module")
def m(spark):
    out = lambda n, **k: {"filename": f"{n:04d}-p.pdf", "title": "T", "size_bytes": 10 * n, "elapsed_seconds": 1.0 * n, **k}
    a = {"version": 2, "start_url": "https://h/display/K/x", "last_updated": "2026-01-02", "crawl_complete": True, "mapped_urls": ["https://h/display/K/a", "https://h/display/K/b", "https://h/c"],
         "exported": {"https://h/display/public/K/a": out(1, sha256="aa"), "https://h/display/K/b": out(2)}, "failures": {"https://h/c": {"error": "e", "attempts": 2}}, "crawl_queue": ["q"]}
    b = {"version": 2, "last_updated": "2026-01-03", "crawl_complete": True, "mapped_urls": ["u"], "exported": {"u": out(3, sha256="cc")}}
    rows = [("/a", json.dumps(a)), ("/b", json.dumps(b)), ("/x", "no json")]
    return parse_manifests(spark.createDataFrame(rows, "dir string, json string")).cache()


@pytest.fixture(scope="module")
def files(spark):
    rows = [("/a", "0001-p.pdf", 10, "aa"), ("/a", "0002-p.pdf", 20, "bb"), ("/a", "0009-old.pdf", 5, "zz"), ("/a", "0003-p.pdf.tmp", 1, "t"), ("/b", "0003-p.pdf", 7, "other")]
    return spark.createDataFrame(rows, "dir string, filename string, size long, sha256 string")


def test_jobs(m):
    got = {r["dir"]: (r["mapped"], r["exported"], r["missing"], r["pending_failures"], r["is_pending"]) for r in c.jobs(m).collect()}
    assert got == {"/a": (3, 2, 1, 1, True), "/b": (1, 1, 0, 0, False)}
    assert [r["dir"] for r in c.jobs(m).collect()] == ["/b", "/a"]
    assert [r["dir"] for r in c.jobs(m, pending_only=True).collect()] == ["/a"]


def test_status(m, files):
    r = {x["dir"]: x for x in c.status(m, files).collect()}["/a"]
    assert (r["mapped_count"], r["exported_count"], r["failures_count"], r["pending_count"], r["queue_remaining"]) == (3, 2, 1, 0, 1)
    assert (r["pdfs_on_disk"], r["total_bytes_on_disk"], r["progress_pct"]) == (3, 35, 66.7)


def test_report_matches_the_exact_url_only(m):
    got = [(r["url"], r["status"]) for r in c.report(m.where("dir = '/a'")).orderBy("idx").collect()]
    assert got == [("https://h/display/K/a", "pending"), ("https://h/display/K/b", "exported"), ("https://h/c", "failed")]
    assert c.report_summary(m.where("dir = '/a'")).first()["total_bytes"] == 20


def test_verify_and_clean(m, files):
    assert {(r["dir"], r["filename"]): r["result"] for r in c.verify(m, files).collect()} == {("/a", "0001-p.pdf"): "ok", ("/a", "0002-p.pdf"): "skipped", ("/b", "0003-p.pdf"): "mismatch"}
    assert c.verify(m, files, limit=1).count() == 2  # the first of each job
    assert [r["filename"] for r in c.clean_tmp(files).collect()] == ["0003-p.pdf.tmp"]
    assert [r["filename"] for r in c.clean_orphans(m, files).collect()] == ["0009-old.pdf"]


def test_changes(m):
    new, found = c.reexport(m, [2, 7])
    assert [tuple(r) for r in found.collect()] == [("/a", 2)]
    assert {r["dir"]: sorted(r["exported"]) for r in new.collect()} == {"/a": ["https://h/display/public/K/a"], "/b": ["u"]}
    with pytest.raises(ValueError, match="range"):
        c.reexport(m, [0])
    assert [r["dir"] for r in c.reset(m, ["/a"]).collect()] == ["/b"]
    assert [r["url"] for r in c.failures(m).collect()] == ["https://h/c"]


def test_exit_codes(spark):
    t = lambda n: spark.range(n)
    code = lambda *a: c.exit_code(*map(t, a[:3]), a[3]).first()[0]
    assert [code(0, 0, 0, True), code(3, 0, 0, True), code(3, 3, 0, True), code(3, 2, 0, True), code(3, 3, 1, True), code(3, 3, 0, False)] == [1, 1, 0, 3, 3, 3]
