import json
from collections import deque
from random import Random

import pytest
from pyspark.sql import functions as F

from pagegraph.operators import consolidate, html, jobstate, pacing, traverse
from pagegraph.operators.ordinal import exact_percentiles, global_ordinal
from pagegraph.session import ship
from pagegraph.sources import manifest, stored

POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "min": 0.0, "max": 1.0}


def test_report_rows(spark):
    m = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "idx long, url string")
    e = spark.createDataFrame([("u1", "a.pdf", "A", 100, 1.0)], "url string, filename string, title string, size_bytes long, elapsed_seconds double")
    f = spark.createDataFrame([("u2", "x", 1)], "url string, error string, attempts int")
    got = {r["url"]: r["status"] for r in jobstate.report_rows(m, e, f).collect()}
    assert got == {"u1": "exported", "u2": "failed", "u3": "pending"}


@pytest.mark.parametrize(
    ("v", "want"),
    [([], (0.0,) * 5), ([-1.0, -2.0], (0.0,) * 5), ([-1.0, 5.0, 10.0], (10.0, 10.0, 10.0, 5.0, 10.0)), ([0.0, 0.0, 5.0], (5.0,) * 5), ([42.5], (42.5,) * 5), ([1.0, 2.0, 3.0, 4.0], (3.0, 4.0, 4.0, 1.0, 4.0)), ([2.0] * 9 + [7.0], (2.0, 7.0, 7.0, 2.0, 7.0))],
)
def test_percentiles(spark, v, want):
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert tuple(exact_percentiles(df, "v", POINTS).first()) == want


def test_global_ordinal(spark):
    df = spark.range(1000).select(F.expr("(id * 37) % 1000").alias("k"), F.lit("x").alias("idx_text"))
    assert all(r["idx"] == r["k"] + 1 for r in global_ordinal(df, [F.col("k")]).collect())


def deque_order(edges, root):
    kids = {}
    for p, o, ch in sorted(edges):
        kids.setdefault(p, []).append(ch)
    out, seen, q = [], {root}, deque([root])
    while q:
        n = q.popleft()
        out.append(n)
        for k in kids.get(n, []):
            if k not in seen:
                seen.add(k)
                q.append(k)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_traversal_of_random_graphs(spark, seed):
    r = Random(seed)
    edges = [(f"n{r.randrange(25)}", o, f"n{r.randrange(25)}") for o in range(60)]
    df = spark.createDataFrame(edges, "parent string, ord long, child string")
    got = [x["node"] for x in traverse.ordered(traverse.bfs(df, "n0")).orderBy("idx").collect()]
    assert got == deque_order(edges, "n0")


def test_sample_tree_and_bound(spark):
    tree = {101: [102, 109], 102: [103, 106, 107, 108], 103: [104, 105], 109: [110, 111, 112, 113]}
    df = spark.createDataFrame([(str(p), o, str(k)) for p, ks in tree.items() for o, k in enumerate(ks)], "parent string, ord long, child string")
    nodes = traverse.ordered(traverse.bfs(df, "101"))
    assert [int(r["node"]) for r in nodes.orderBy("idx").collect()] == [101, 102, 109, 103, 106, 107, 108, 110, 111, 112, 113, 104, 105]
    top = traverse.bounded(nodes, 3).orderBy("idx").collect()
    assert [r["pending"] for r in top] == [False, False, True]


def test_restore(spark):
    t = lambda rows: spark.createDataFrame(rows, "ord long, url string")
    seen, queue = traverse.restore(t([(0, "r"), (1, "a"), (2, "b")]), t([(0, "b"), (1, "c"), (2, "b")]), t([(0, "a")]), "r")
    assert [r["url"] for r in seen.collect()] == ["r"]
    assert [r["url"] for r in queue.collect()] == ["b", "c", "a"]


def test_consolidation_prefers_the_exact_form(spark):
    m = spark.createDataFrame([(1, "https://h/display/public/K/a"), (2, "https://h/display/K/b"), (3, "https://h/x")], "idx long, url string")
    e = spark.createDataFrame([("https://h/display/K/a", "short.pdf"), ("https://h/display/public/K/a", "exact.pdf"), ("https://h/display/public/K/b", "b.pdf")], "url string, filename string")
    got = {r["idx"]: r["filename"] for r in jobstate.consolidation_set(m, e).collect()}
    assert got == {1: "exact.pdf", 2: "b.pdf"}


def test_verify_order_of_tests(spark):
    e = spark.createDataFrame([("a", "1"), ("b", ""), ("c", ""), ("d", "1"), ("e", "1")], "filename string, sha256 string")
    d = spark.createDataFrame([("a", "1", False), ("b", "x", False), ("d", "2", False), ("e", None, True)], "filename string, actual string, io_error boolean")
    assert {r[0]: r[1] for r in jobstate.verify(e, d).collect()} == {"a": "ok", "b": "skipped", "c": "missing", "d": "mismatch", "e": "io_error"}


def pace(spark, rows, **conf):
    df = spark.createDataFrame([("x", i, *r) for i, r in enumerate(rows)], "exit string, seq long, ts double, event string, retry_after double, started_at double")
    return pacing.pacing(df, p=pacing.Pacing(**conf)).first()


def test_pacing(spark):
    b, ok = (lambda t, r=None, s=None: (float(t), "block", r, s)), (lambda t: (float(t), "ok", None, None))
    assert [pace(spark, [b(i) for i in range(n)])["delay"] for n in (1, 2)] == [4.0, 8.0]
    assert pace(spark, [b(0, 600.0), b(1000, 600.0)])["longest"] == 602.0
    assert pace(spark, [b(0), b(100), b(200)], initial=10.0)["longest"] == 40.0
    r = pace(spark, [b(0), b(1), *(ok(2 + i) for i in range(3))], recover_after=3, recover_factor=0.5)
    assert r["delay"] == 4.0
    assert pace(spark, [b(0), b(1), *(ok(2 + i) for i in range(30))], recover_after=3, recover_factor=0.5)["delay"] == 2.0
    assert pace(spark, [b(i) for i in range(6)], most_delay=5.0)["delay"] == 5.0
    late = pace(spark, [b(10), b(11, None, 9.0)])
    assert (late["blocks"], late["delay"]) == (1, 4.0)
    switch = lambda t, wait=None: (float(t), "switch", wait, None)
    after = pace(spark, [b(10), switch(20, 5.0), b(30, None, 9.0)])
    assert (after["blocks"], after["until"], after["k"]) == (1, 25.0, 1)  # sent from the exit that was left
    again = pace(spark, [b(10), switch(20), b(30, None, 9.0), b(40, None, 39.0), b(200, None, 39.5)])
    assert again["blocks"] == 3  # blocks of the new exit count, and the switch was before the last of them


def test_exit_quarantine(spark):
    for n, want in ((2, (0.0, False)), (3, (600.0, False)), (6, (1200.0, False)), (9, (1200.0, True))):
        df = spark.createDataFrame([("x", i, i, True) for i in range(n)], "exit string, ts long, seq long, failed boolean")
        r = pacing.exit_quarantine(df).first()
        assert (r["penalty"], r["dead"]) == want
    direct = spark.createDataFrame([(None, i, i, True) for i in range(9)], "exit string, ts long, seq long, failed boolean")
    assert pacing.exit_quarantine(direct).first()["dead"] is False


def test_probe_rank(spark):
    rows = [(0, "slow", True, 3.0, "1.2.3.4", True), (1, "fast", True, 1.0, "1.2.3.4", True), (2, "other", True, 2.0, "5.6.7.8", True), (3, "n1", True, 4.0, "", True), (4, "n2", True, 5.0, "", True), (5, "dead", False, 0.1, "9", True)]
    df = spark.createDataFrame(rows, "ord long, exit string, ok boolean, seconds double, ip string, tested boolean")
    assert [r["exit"] for r in pacing.rank_probes(df).collect()] == ["fast", "other", "n1", "n2"]
    assert pacing.rank_probes(df, unique_ip=False).count() == 5


def test_manifest_reading_and_migration(spark, tmp_path):
    old = {"version": 1, "start_url": "https://h/x", "crawl_complete": True, "mapped_urls": ["https://h/a", "https://h/b"], "failures": {"https://h/a": "timeout apos 3 tentativas", "https://h/b": "erro generico"}}
    new = {"version": 2, "mapped_urls": [], "crawl_complete": True, "failures": {"u": {"error": "e", "attempts": 4, "last_attempt": "t"}}, "exported": {"u": {"filename": "f", "title": "t", "size_bytes": 5, "elapsed_seconds": 1.5}}}
    for name, doc in (("a", old), ("b", new), ("c", {"version": 9, "mapped_urls": ["x"]}), ("d", {"other": 1})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(doc))
    deep = tmp_path / "1/2/3/4"
    deep.mkdir(parents=True)
    (deep / "manifest.json").write_text(json.dumps(old))
    m = manifest.read_manifests(spark, str(tmp_path)).cache()
    assert sorted(r["dir"][-2:] for r in m.collect()) == ["/a", "/b"]
    tries = {r["url"]: r["attempts"] for r in manifest.failures(m).collect()}
    assert tries == {"https://h/a": 3, "https://h/b": 1, "u": 4}
    assert {r["dir"][-1]: r["crawl_complete"] for r in m.collect()} == {"a": True, "b": False}
    assert manifest.exported(m).first()["size_bytes"] == 5
    assert [r["idx"] for r in manifest.mapped(m).orderBy("idx").collect()] == [1, 2]
    at = str(tmp_path / "snap")
    manifest.write_snapshot(m, at, 1)
    assert manifest.latest_snapshot(spark, at) == manifest.write_snapshot(m, at, 2)[:-1] + "1" or manifest.latest_snapshot(spark, at).endswith("2")


def test_child_listing(spark):
    page = {"size": 4, "limit": 200, "_links": {}, "results": [
        {"id": "10", "_links": {"webui": "/display/K/a"}, "children": {"page": {"size": 1, "results": [{"id": "11"}]}}},
        {"id": "20", "_links": {"webui": "/display/K/b"}, "children": {"page": {"size": 0}}},
        {"id": "30", "_links": {"webui": "/display/K/c"}}, {"id": "40", "_links": {}}]}
    raw = spark.createDataFrame([("1", 0, json.dumps(page)), ("1", 200, json.dumps({"size": 200, "limit": 200, "results": []}))], "parent_id string, start int, json string")
    pages = stored.api_pages(raw).cache()
    assert {r["start"]: r["more"] for r in pages.collect()} == {0: False, 200: True}
    refs = {r["page_id"]: (r["url"], r["is_leaf"]) for r in stored.child_refs(pages, "https://h", True).collect()}
    assert refs == {"10": ("https://h/display/public/K/a", False), "20": ("https://h/display/public/K/b", True), "30": ("https://h/display/public/K/c", None)}


def test_files(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.4\n" + b"x" * 4000 + b"\n%%EOF")
    (tmp_path / "small.pdf").write_bytes(b"%PDF-1.4\n%%EOF")
    (tmp_path / "page.pdf").write_bytes(b"<html>" + b"x" * 4000 + b"%%EOF")
    got = {r["filename"]: r["valid"] for r in stored.checked_files(stored.binary_files(spark, str(tmp_path))).collect()}
    assert got == {"good.pdf": True, "small.pdf": False, "page.pdf": False}


def test_exit_list(spark):
    lines = spark.createDataFrame(enumerate(["# c", "", "h:1", " http://h:1 ", "direct", "gopher://x"], 1), "n long, line string")
    assert sorted((r["n"], r["bad"]) for r in stored.exit_list(lines).collect()) == [(3, False), (6, True)]


def test_markdown_and_places(spark):
    ship(spark)
    page = '<html><head><title>T &amp; x</title></head><body><nav>menu</nav><div id="main-content"><h2>Head</h2><p>Text <b>bold</b> and <a href="/l">link</a>.</p><ul><li>one<li>two</ul><script>x</script><pre>a\n b</pre></div><article>no</article></body></html>'
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got = {r["page_id"]: r["m"] for r in df.select("page_id", html.content_markdown("html").alias("m")).collect()}
    assert got[1] == "## Head\n\nText **bold** and [link](/l).\n\n- one\n- two\n\n```\na\n b\n```"
    assert got[2] is None and got[3] is None
    assert df.select(html.title(F.col("html"))).first()[0] == "T & x"


def test_tree_children(spark):
    ship(spark)
    tree = '<div class="plugin_pagetree"><ul><li><a data-page-id="1" href="/r">r</a><ul><li><a href="/a">a</a></li><li><a href="/b#x">b</a></li><li><a href="/r">r</a></li></ul></li><li><a href="/display/public/K/c">c</a><ul><li><a href="/d">d</a></li></ul></li></ul></div>'
    meta = '<meta name="ajs-page-id" content="1">'
    section = '<div id="children-section"><a href="/s1">x</a><a href="/s1">x</a><a href="/s2">y</a></div>'
    rows = [(1, "https://h/r", meta + tree), (2, "https://h/display/K/c#top", tree), (3, "https://h/other", tree + section), (4, "https://h/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["href"]) for r in html.tree_children(df).orderBy("page_id", "ord").collect()]
    assert got == [(1, "/a"), (1, "/b#x"), (2, "/d"), (3, "/s1"), (3, "/s2")]


def test_asset_names(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "Pagina A", 0, "/download/attachments/123/diagrama.png"), (1, "Pagina A", 1, "/x/Diagrama.png"), (1, "Pagina A", 2, "/download/attachments/123/diagrama.png")], "page_id long, title string, ord long, url string")
    assert [r["local"] for r in html.asset_names(df).orderBy("ord").collect()] == ["../attachments/pagina-a/diagrama.png", "../attachments/pagina-a/diagrama-2.png"]


def test_document(spark):
    df = spark.createDataFrame([(1, "Pagina A", "0001-a", "body a"), (2, " ", "0002-b", "body b"), (3, "C", "c", None)], "idx int, title string, stem string, body string")
    d = consolidate.document(df, "Job").first()[0]
    assert "## Indice" in d and "[Pagina A](#page-1)" in d and '<a id="page-2"></a>' in d and "[0002-b](#page-2)" in d and "page-3" not in d
    assert consolidate.document(df.where("false"), "Job").count() == 0 == consolidate.pieces(df.where("false"), "Job").count()
    assert d == '# Job\n\n## Indice\n\n1. [Pagina A](#page-1)\n2. [0002-b](#page-2)\n\n---\n\n<a id="page-1"></a>\n\nbody a\n\n---\n\n<a id="page-2"></a>\n\nbody b\n\n---\n'
    assert d == "".join(r["text"] for r in consolidate.pieces(df, "Job").orderBy("part", "idx").collect())


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("https://h.example/page?title=foo,bar", 'Titulo, com "virgula"\r\nx')], "url string, title string")
    consolidate.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert back["url"] == "https://h.example/page?title=foo,bar" and back["title"] == 'Titulo, com "virgula"  x'


def test_slots_follow_the_recurrence(spark):
    import random

    r = random.Random(3)
    rows = [(k, i, float(r.randrange(50)), r.choice([0.0, 0.0, 20.0, 60.0])) for k in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "exit int, seq long, now double, cooldown_until double").repartition(3)
    got = {(x["exit"], x["seq"]): x["slot"] for x in pacing.slots(df, 2.5).collect()}
    last = {}
    for k, i, now, cool in rows:
        last[k] = max(now, cool, last.get(k, -1e18) + 2.5)
        assert got[k, i] == last[k]


def test_snapshots_expire(spark, tmp_path):
    import os

    m = spark.createDataFrame([("/a", "x")], "dir string, json string")
    for v in range(1, 9):
        manifest.write_snapshot(m, str(tmp_path), v)
    assert len(manifest.expire_snapshots(spark, str(tmp_path), keep=5)) == 2
    assert sorted(x for x in os.listdir(tmp_path) if x.startswith("v=")) == [f"v={v:08d}" for v in range(3, 9)]
    assert manifest.expire_snapshots(spark, str(tmp_path), keep=5) == [] and manifest.latest_snapshot(spark, str(tmp_path)).endswith("v=00000008")


def test_http_dates_in_all_forms(spark):
    from pagegraph.functions import classify
    from pagegraph.session import ship

    ship(spark)
    forms = ["Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "Sun, 6 Nov 1994 10:49:37 +0200", "nonsense", None]
    df = spark.createDataFrame([(x,) for x in forms], "v string")
    assert [r[0] for r in df.select(classify.retry_after(F.col("v"), F.lit(784111700.0))).collect()] == [77.0] * 4 + [None, None]


def test_stored_pdfs(spark):
    from pagegraph.sources import stored

    body = lambda head, end=b"%%EOF": head + b"x" * 4000 + end
    cases = [(body(b"%PDF-1.4 12345678 <html>"), True), (body(b"%pdf-1.4"), False), (body(b"%PDF-1<!DOCTYPE"), False), (body(b"%PDF-1.4", b""), False), (b"%PDF-%%EOF", False)]
    df = spark.createDataFrame([(f"f{i}", len(c), bytearray(c)) for i, (c, _) in enumerate(cases)], "path string, length long, content binary")
    got = {r["filename"]: r["valid"] for r in stored.checked_files(df).collect()}
    assert [got[f"f{i}"] for i in range(len(cases))] == [v for _, v in cases]


def test_exit_lists_grow_and_clear(spark):
    from pagegraph import commands

    known = spark.createDataFrame([(1, "http://a:80"), (2, "http://b:80")], "n long, exit string")
    lines = spark.createDataFrame([(1, "# x"), (2, "b"), (3, "c"), (4, "c:80"), (5, "ftp://d")], "n long, line string")
    assert [(r["n"], r["exit"]) for r in commands.add_exits(known, lines).orderBy("n").collect()] == [(1, "http://a:80"), (2, "http://b:80"), (5, "http://c:80")]
    assert commands.clear_exits(known).count() == 0


def test_staged_tables_go_with_their_scope(spark):
    import os

    from pagegraph.session import stage, staging

    kept = stage(spark.range(3), "kept")
    with staging():
        gone = stage(spark.range(4), "gone").inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert os.path.isdir(gone)
    assert not os.path.exists(gone) and kept.count() == 3


def test_folds_in_slices_give_the_same(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    k = F.when(F.col("user_id") % 5 == 0, None).otherwise(F.col("user_id") % 5).alias("k")
    kind = F.element_at(F.array(*map(F.lit, ("ok", "block", "error", "timeout"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select(k, F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"))
    cases = [
        lambda n: pacing.pacing(rows.select("k", "ts", "seq", F.when(F.col("kind") == "block", "block").otherwise("ok").alias("event"), F.lit(None).cast("double").alias("retry_after"), F.lit(None).cast("double").alias("started_at")), "k", slices=n),
        lambda n: pacing.exit_quarantine(rows.select("k", "ts", "seq", (F.col("kind") != "ok").alias("failed")), "k", slices=n),
        lambda n: pacing.retry_rounds(rows.select("k", "ts", "seq", F.replace("kind", F.lit("block"), F.lit("blocked")).alias("outcome"), F.lit(True).alias("at_exit")), "k", slices=n),
        lambda n: pacing.request_bans(rows.select("k", F.col("ts").alias("t"), "seq", (F.col("kind") != "ok").alias("counted")), "k", 4e11, 2, 5e11, 1e11, slices=n),
        lambda n: pacing.node_retries(rows, "k", slices=n),
    ]
    for fold in cases:
        whole = sorted(map(str, fold(1).collect()))
        assert len(whole) == 5 and all(sorted(map(str, fold(n).collect())) == whole for n in (2, 7))


def test_exit_and_json_sinks(spark, tmp_path):
    exits = spark.createDataFrame([("http://a:80",), ("socks5://b:1080",)], "exit string")
    consolidate.write_exits(exits, str(tmp_path / "exits"), "# head")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "exits")).collect()]
    assert lines[0] == "# head" and sorted(lines[1:]) == ["http://a:80", "socks5://b:1080"]
    listed = stored.exit_list(spark.createDataFrame(list(enumerate(lines, 1)), "n long, line string"))
    assert sorted(r["exit"] for r in listed.collect()) == ["http://a:80", "socks5://b:1080"]
    consolidate.write_json(spark.createDataFrame([(1, None, 'a "b"')], "idx long, error string, title string"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"idx": 1, "error": None, "title": 'a "b"'}


def test_map_made_again(spark):
    case = lambda *x: spark.createDataFrame([x], "n int, p int, o int, lim boolean").select(jobstate.remap_outcome(*map(F.col, ("n", "p", "o", "lim")))).first()[0]
    assert case(1, 0, 30, False) == "keep"  # the start page alone
    assert case(1, 0, 1, False) == "replace" and case(1, 0, None, False) == "replace"
    assert case(20, 3, 30, False) == "keep" and case(20, 3, 30, True) == "partial" and case(20, 3, None, False) == "partial"


def test_pages_to_resume(spark):
    from pagegraph import commands

    doc = {"version": 2, "mapped_urls": ["a", "b", "c", "d"], "exported": {"a": {"filename": "f"}}, "exported_md": {"b": {"filename": "g"}}, "failures": {"b": {"error": "x", "attempts": 4}, "c": {"error": "x", "attempts": 5}}}
    m = manifest.parse_manifests(spark.createDataFrame([("/j", json.dumps(doc))], "dir string, json string"))
    got = {mode: sorted(r["url"] for r in commands.resume_plan(m, mode).collect()) for mode in ("auto", "retry", "all")}
    assert got == {"auto": ["d"], "retry": ["b"], "all": ["a", "b", "c", "d"]}
    assert sorted(r["url"] for r in commands.markdown_pages(m).collect()) == ["a", "c", "d"]
    with pytest.raises(ValueError, match="mode"):
        commands.resume_plan(m, "other")


def test_a_listing_is_read_to_its_twentieth_page(spark):
    import json

    from pagegraph.sources import stored

    def page(start, n, more=True, total=None):
        body = {"results": [{"id": str(start + i), "_links": {"webui": f"/x/{start + i}"}} for i in range(n)], "limit": n or 5}
        return start, json.dumps(body | ({"_links": {"next": "/n"}} if more else {}))

    stored_of = {
        "long": [page(50 * i, 50) for i in range(30)],
        "exact": [page(3 * i, 3) for i in range(19)] + [(57, json.dumps({"results": [{"id": "57"}], "limit": 3}))],
        "short": [page(0, 5), page(5, 0)],
        "not json": [(0, "{")],
    }
    raw = spark.createDataFrame([(k, s, j) for k, pages in stored_of.items() for s, j in pages], "parent_id string, start long, json string")
    got = {}
    for r in stored.api_pages(raw).orderBy("start").collect():
        got.setdefault(r["parent_id"], []).append((r["start"], r["truncated"]))
    assert got == {
        "long": [(50 * i, True) for i in range(20)],
        "exact": [(3 * i, False) for i in range(20)],
        "short": [(0, False), (5, False)],
        "not json": [(0, False)],
    }


def test_own_item_of_a_tree():
    url, meta = "https://h.example/display/S/me", '<meta name="ajs-page-id" content="7">'
    by_link = '<div id="sidebar"><ul><li><a href="/display/S/me">me</a> <a href="/beside">b</a><ul><li><a href="/kid">k</a></li></ul></li></ul></div>'
    outside = '<div class="plugin_pagetree"><span data-page-id="7"></span><ul><li data-page-id="7"><a href="/wrong">w</a></li></ul></div>'
    assert html.child_hrefs(meta + outside + by_link, url) == ["/beside", "/kid"]  # the first node with the id lies in no item
    bare = '<div class="plugin_pagetree"><a href="/display/S/me">me</a></div>'
    assert html.child_hrefs(bare + by_link, url) == ["/beside", "/kid"]
    other = '<div class="plugin_pagetree"><ul><li data-page-id="8"><a href="/x">x</a></li></ul></div><div id="page-tree"><ul><li data-page-id="7"><a href="/y">y</a></li></ul></div>'
    assert html.child_hrefs(meta + other, url) == ["/y"]
    assert html.child_hrefs(meta + bare, url) == []


def test_snapshot_writers_that_break_off_or_collide(spark, tmp_path, monkeypatch):
    import os

    root, schema = str(tmp_path / "jobs"), "dir string, n long"
    one = lambda n: spark.createDataFrame([("/a", n)], schema)
    now = lambda: [tuple(r) for r in manifest.read_snapshot(spark, manifest.latest_snapshot(spark, root), schema).collect()]
    assert manifest.latest_snapshot(spark, root) is None and manifest.recover_snapshots(spark, root) == []
    put = manifest._put_if_absent

    def dies(*_):
        raise RuntimeError("gone")

    monkeypatch.setattr(manifest, "_put_if_absent", dies)  # the data is written, the version is not
    with pytest.raises(RuntimeError):
        manifest.write_snapshot(one(0), root, 1)
    assert manifest.latest_snapshot(spark, root) is None and len(os.listdir(f"{root}/_tmp")) == 1
    monkeypatch.setattr(manifest, "_put_if_absent", put)
    manifest.write_snapshot(one(1), root, 1)  # what broke off is in nobody's way
    assert now() == [("/a", 1)]
    with pytest.raises(manifest.SnapshotTaken):
        manifest.write_snapshot(one(2), root, 1)
    assert now() == [("/a", 1)] and len(os.listdir(f"{root}/_tmp")) == 1
    assert manifest.recover_snapshots(spark, root) == [] and len(manifest.recover_snapshots(spark, root, -5.0)) == 1
    rivals = [10, 100]

    def slow(old):
        if rivals:  # another writer is faster, twice
            by = rivals.pop()
            manifest.update_snapshot(spark, root, schema, lambda x: x.withColumn("n", F.col("n") + by))
        return old.withColumn("n", F.col("n") * 2)

    manifest.update_snapshot(spark, root, schema, slow)
    assert now() == [("/a", 222)] and [v for v, _ in manifest.versions(spark, root)] == [4, 3, 2, 1]
    rivals += [1] * 9
    with pytest.raises(manifest.SnapshotTaken):
        manifest.update_snapshot(spark, root, schema, slow, tries=2)


def test_every_other_directory_of_a_start_page_is_named(spark):
    jobs = [("a", "https://H.example/display/public/N1/"), ("b", "http://h.example/display/N1?src=x"), ("c", "http://h.example/display/N1"), ("d", "http://h.example/display/N2"), ("e", None)]
    got = sorted(map(tuple, jobstate.same_job(spark.createDataFrame(jobs, "dir string, start_url string")).select("dir", "other").collect()))
    assert got == [(x, y) for x in "abc" for y in "abc" if x != y]
