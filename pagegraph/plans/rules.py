"""More of the catalogue: rules of parsing, listing, naming and checking, and machines over logs.

Inputs are derived from stored tables so that every branch of a rule occurs; the SQL states the rule itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import commands
from ..functions import classify, text, urls
from ..operators import consolidate, html, jobstate, pacing, recording, traverse
from ..operators.ordinal import global_ordinal
from ..session import ship, stage, stage_path, table
from ..sources import manifest, stored
from .catalogue import _FAIL, _TURNS, JOB_SQL, job, query


def literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def listed(samples: tuple) -> str:
    """The samples as a list in SQL."""
    return "[" + ", ".join(map(literal, samples)) + "]"


def picked(samples: tuple, k: Column) -> Column:
    """The sample that a number falls on."""
    return F.element_at(F.array(*(F.lit(x).cast("string") for x in samples)), (F.pmod(k, F.lit(len(samples))) + 1).cast("int"))


# --- parsing --------------------------------------------------------------------------------------------

WAITS = (" 17 ", "0", "-1", "1.5", "86400", "86401", "abc", "", None, "\t30\n", "1e2", "Wed, 21 Oct 2015 07:28:10 GMT", "Wednesday, 21-Oct-15 07:28:20 GMT", "Wed Oct 21 07:28:30 2015", "Wed, 21 Oct 2015 09:28:40 +0200", "Wed, 21 Oct 2015 07:27:00 GMT", "Thu, 22 Oct 2015 07:28:01 GMT", "Thu, 5 Nov 2015 07:28:00 +0000", "21 Oct 2015 07:28:50 +0000")


@query(
    rf"""WITH e AS (SELECT event_id, trim({listed(WAITS)}[event_id % {len(WAITS)} + 1], ' ' || chr(9) || chr(10)) AS t FROM events),
s AS (SELECT event_id, coalesce(TRY_CAST(t AS DOUBLE), epoch(coalesce(try_strptime(t, ['%a, %d %b %Y %H:%M:%S GMT', '%A, %d-%b-%y %H:%M:%S GMT', '%a %b %d %H:%M:%S %Y']),
  try_strptime(t, ['%a, %d %b %Y %H:%M:%S %z', '%d %b %Y %H:%M:%S %z']) AT TIME ZONE 'UTC')) - 1445412480.0::DOUBLE) AS v FROM e)
SELECT event_id, CASE WHEN v BETWEEN 0 AND 86400 THEN v END AS seconds FROM s"""
)
def retry_after_forms(spark, d):
    ship(spark)
    return table(spark, d, "events").select("event_id", classify.retry_after(picked(WAITS, F.col("event_id")), F.lit(1445412480.0)).alias("seconds"))


ERRORS = ("net::ERR_TIMED_OUT at https://h.example/A?x=1 Now", "  padded  ", "Page.goto: Timeout 30000ms exceeded.\nCall log:\n  - navigating to https://h.example", "x" * 40, "HTTP 503 \n", "https://a.example/b and http://c.example", "")


@query(
    rf"""WITH e AS (SELECT event_id, split_part({listed(ERRORS)}[event_id % {len(ERRORS)} + 1], chr(10) || 'Call log:', 1) AS t FROM events),
s AS (SELECT event_id, t, regexp_replace(t, '^\s+|\s+$', '', 'g') AS u FROM e)
SELECT event_id, lower(regexp_replace(t, 'https?://\S+', '<url>', 'g')) AS headline, CASE WHEN length(u) <= 30 THEN u ELSE substr(u, 1, 27) || '...' END AS short FROM s"""
)
def error_texts(spark, d):
    m = picked(ERRORS, F.col("event_id"))
    return table(spark, d, "events").select("event_id", classify.headline(m).alias("headline"), classify.short_error(m, 30).alias("short"))


@query(
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') || {listed(("", *(m.upper() for m in classify.CHALLENGE_PAGE)))}[doc_id % {len(classify.CHALLENGE_PAGE) + 1} + 1] AS body FROM documents)
SELECT doc_id, {" OR ".join(f"contains(lower(body), {literal(m)})" for m in classify.CHALLENGE_PAGE)} AS challenge FROM t"""
)
def challenge_pages(spark, d):
    more = picked(("", *(m.upper() for m in classify.CHALLENGE_PAGE)), F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", classify.is_challenge_page(F.concat(F.coalesce("text", F.lit("")), more)).alias("challenge"))


QUERIES_OF = ("?pageId=12", "?x=1&pageId=7&pageId=8", "?pageId=7a", "?pageId=", "", "?pageid=5", "#pageId=9", "?spaceKey=K&pageId=00123#top")


@query(
    rf"""WITH u AS (SELECT page_id, url || {listed(QUERIES_OF)}[page_id % {len(QUERIES_OF)} + 1] AS u FROM pages),
v AS (SELECT page_id, regexp_extract(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '(^|&)pageId=([^&]*)', 2) AS v FROM u)
SELECT page_id, CASE WHEN regexp_full_match(v, '[0-9]+') THEN v END AS id FROM v"""
)
def page_id_from_url(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", urls.page_id(F.concat("url", picked(QUERIES_OF, F.col("page_id")))).alias("id"))


HREFS = ("/a", "", "#top", " javascript:void(0)", "JavaScript:x", "https://h.example/b", "  ", "HTTP://x", "http://y ", "mailto:z", "\thttps://z")


@query(
    rf"""WITH h AS (SELECT event_id, regexp_replace({listed(HREFS)}[event_id % {len(HREFS)} + 1], '^\s+|\s+$', '', 'g') AS h FROM events)
SELECT event_id, h <> '' AND NOT starts_with(h, '#') AND NOT starts_with(lower(h), 'javascript:') AS page, regexp_matches(h, '^https?://') AS http FROM h"""
)
def href_filter(spark, d):
    h = picked(HREFS, F.col("event_id"))
    return table(spark, d, "events").select("event_id", urls.is_page_href(h).alias("page"), urls.is_http(h).alias("http"))


HOSTS = ("https://H.example/a", "http://h.EXAMPLE/b?c", "https://other.example", "not a url", "", "//h.example/x", "https://h.example:8443/a")


@query(
    f"""WITH p AS (SELECT event_id, {listed(HOSTS)}[event_id % 7 + 1] AS a, {listed(HOSTS)}[(event_id // 7) % 7 + 1] AS b FROM events),
h AS (SELECT event_id, lower(regexp_extract(a, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)) AS x, lower(regexp_extract(b, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)) AS y FROM p)
SELECT event_id, x <> '' AND x = y AS same FROM h"""
)
def same_origin_pairs(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", urls.same_origin(picked(HOSTS, i), picked(HOSTS, F.floor(i / 7))).alias("same"))


PATHS = ("a/b.pdf", "/etc/x", "../up", "a/../b", "a\\..\\b", "a..b/c", "x" * 240, "x" * 241, "..", "")


@query(
    rf"""WITH p AS (SELECT event_id, {listed(PATHS)}[event_id % {len(PATHS)} + 1] AS p FROM events)
SELECT event_id, CASE WHEN starts_with(p, '/') OR list_contains(string_split(replace(p, '\', '/'), '/'), '..') THEN 'traversal' WHEN length(p) > 240 THEN 'too long' END AS problem FROM p"""
)
def path_problems(spark, d):
    return table(spark, d, "events").select("event_id", text.path_problem(picked(PATHS, F.col("event_id"))).alias("problem"))


NAMES = (None, "", "  ", " Guide ", "a.pdf", "B.PDF", "what?", "x/y", "m.md")


@query(
    rf"""WITH n AS (SELECT event_id, {listed(NAMES)}[event_id % 9 + 1] AS flag, {listed(NAMES)}[(event_id // 9) % 9 + 1] AS saved FROM events),
c AS (SELECT event_id, coalesce(nullif(trim(flag), ''), nullif(trim(saved), ''), 'guess') AS n FROM n)
SELECT event_id, CASE WHEN NOT regexp_matches(n, '[<>:"/\\|?*]') THEN n || CASE WHEN lower(n) LIKE '%.pdf' THEN '' ELSE '.pdf' END END AS name FROM c"""
)
def consolidated_names(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", consolidate.consolidated_name(picked(NAMES, i), picked(NAMES, F.floor(i / 9)), F.lit("guess")).alias("name"))


STATUSES = ("200", "301", "404", "410", "403", "429", "500", None)


@query(
    f"""WITH s AS (SELECT event_id, CAST({listed(STATUSES)}[event_id % 8 + 1] AS INTEGER) AS s, event_id % 3 = 0 AS root FROM events)
SELECT event_id, CASE WHEN s IN (404, 410) AND NOT root THEN 'no children' WHEN s >= 400 THEN 'failed' ELSE 'read' END AS listing FROM s"""
)
def listing_statuses(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", classify.listing_status(picked(STATUSES, i).cast("int"), i % 3 == 0).alias("listing"))


@query(
    f"""WITH e AS (SELECT user_id AS nav_id, CAST({listed(STATUSES)}[event_id % 8 + 1] AS INTEGER) AS s, event_id % 11 = 0 AS dropped, event_type = 'signup' AS lenient FROM events),
n AS (SELECT nav_id, count(*) FILTER (WHERE s = 429) AS n_limited, count(*) FILTER (WHERE s >= 500) AS n_server, count(*) FILTER (WHERE dropped) AS n_dropped,
  coalesce(array_to_string(list_sort(list(DISTINCT s) FILTER (WHERE s = 429 OR s >= 500)), '/'), '') AS statuses, bool_or(lenient) AS lenient FROM e GROUP BY nav_id)
SELECT nav_id, n_limited, n_server, n_dropped, statuses, CASE WHEN n_limited > 0 THEN 'blocked' WHEN n_server + n_dropped > 0 AND NOT lenient THEN 'transient' ELSE 'ok' END AS verdict FROM n"""
)
def asset_verdicts(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events")
    return classify.asset_verdicts(e.select(F.col("user_id").alias("nav_id"), picked(STATUSES, i).cast("int").alias("status"), (i % 11 == 0).alias("dropped"), (F.col("event_type") == "signup").alias("lenient")))


# --- stored listings, documents and files ---------------------------------------------------------------


def _listing(spark, d) -> DataFrame:
    """Raw REST pages: the customers of a nation, one to three to a page, as the server's JSON."""
    c = table(spark, d, "customer").withColumn("nth", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)
    k = F.col("c_custkey")
    size = F.when(k % 3 == 0, k % 2)
    kids = F.when(k % 3 == 1, F.when(k % 2 == 0, F.array().cast("array<struct<id:string>>")).otherwise(F.array(F.struct(k.cast("string").alias("id")))))
    link = F.when(k % 10 != 9, F.concat(F.lit("/display/public/S/P"), k))
    per = 1 + F.col("c_nationkey") % 3
    row = F.struct(k.cast("string").alias("id"), F.struct(link.alias("webui")).alias("_links"), F.struct(F.struct(size.cast("int").alias("size"), kids.alias("results")).alias("page")).alias("children"))
    pages = c.groupBy(F.col("c_nationkey").alias("parent_id"), (F.floor(F.col("nth") / per) * per).alias("start")).agg(F.array_sort(F.collect_list(F.struct("nth", row.alias("r")))).alias("rows"))
    pages = pages.withColumn("last", F.max("start").over(Window.partitionBy("parent_id")) == F.col("start"))
    body = F.struct(F.size("rows").alias("size"), (1 + F.col("parent_id") % 3).alias("limit"), F.struct(F.when(~F.col("last"), "/next").alias("next")).alias("_links"), F.transform("rows", lambda x: x["r"]).alias("results"))
    return pages.select("parent_id", "start", F.to_json(body).alias("json"))


@query(
    """WITH c AS (SELECT c_nationkey AS parent_id, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord FROM customer)
SELECT parent_id, ord, 'https://h.example/display/S/P' || k AS url, CAST(k AS VARCHAR) AS page_id, CASE k % 3 WHEN 0 THEN k % 2 = 0 WHEN 1 THEN k % 2 = 0 END AS is_leaf FROM c WHERE k % 10 <> 9 AND ord < 20 * (1 + parent_id % 3)"""
)
def listed_children(spark, d):
    return stored.child_refs(stored.api_pages(_listing(spark, d)), "https://h.example", False)


@query(
    """WITH c AS (SELECT c_nationkey AS parent_id, 1 + c_nationkey % 3 AS per, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth FROM customer),
p AS (SELECT parent_id, per, nth // per * per AS start, count(*) AS n FROM c GROUP BY 1, 2, 3),
m AS (SELECT *, start < max(start) OVER (PARTITION BY parent_id) OR n >= per AS more FROM p)
SELECT parent_id, CAST(start AS BIGINT) AS start, more, CAST(start + n AS BIGINT) AS next, max(more AND start = 19 * per) OVER (PARTITION BY parent_id) AS truncated FROM m WHERE start < 20 * per"""
)
def listing_pages(spark, d):
    return stored.api_pages(_listing(spark, d)).select("parent_id", F.col("start").cast("long").alias("start"), "more", stored.next_start(F.col("start"), F.col("results")).cast("long").alias("next"), "truncated")


@query(
    """WITH s AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord FROM supplier)
SELECT s_nationkey AS page_id, CAST(ord AS INTEGER) AS ord, '/display/S/C' || s_suppkey AS href FROM s WHERE s_nationkey % 4 <> 3"""
)
def tree_child_links(spark, d):
    """Trees in which a page finds itself by id or by link, a list of children, and pages without either."""
    ship(spark)
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.concat(F.lit('<li><a href="/display/S/C'), k, F.lit('">c</a></li>'))).alias("kids"))
    n, kids = F.col("s_nationkey"), F.array_join("kids", "")
    own = F.concat(F.lit("https://h.example/display/S/P"), n)
    by_id = F.concat(F.lit('<meta name="ajs-page-id" content="'), n, F.lit('"><div class="plugin_pagetree"><ul><li><a href="/x">x</a></li><li data-page-id="'), n, F.lit('"><a href="/display/S/P'), n, F.lit('">me</a><ul>'), kids, F.lit("</ul></li></ul></div>"))
    by_link = F.concat(F.lit('<div id="sidebar"><ul><li><a href="/display/public/S/P'), n, F.lit('#top">me</a><ul>'), kids, F.lit('</ul></li><li><a href="/display/S/other">o</a></li></ul></div>'))
    macro = F.concat(F.lit('<div class="childpages-macro"><ul>'), kids, F.lit("</ul></div>"))
    page = F.when(n % 4 == 0, by_id).when(n % 4 == 1, by_link).when(n % 4 == 2, macro).otherwise(F.concat(F.lit("<div><ul>"), kids, F.lit("</ul></div>")))
    return html.tree_children(s.select(n.alias("page_id"), own.alias("url"), F.concat(F.lit("<html><body>"), page, F.lit("</body></html>")).alias("html")))


ASSETS = ("a b.png", "A-B.PNG", "diagram.extension_too_long", "noext", "a b.png", "C++ notes.txt", "notes (1).md")


@query(
    rf"""WITH a AS (SELECT event_id AS ord, user_id AS page_id, {listed(ASSETS)}[event_id % 7 + 1] AS base, event_id % 2 AS v FROM events),
o AS (SELECT page_id, base, v, min(ord) AS ord FROM a GROUP BY 1, 2, 3),
n AS (SELECT page_id, ord, base, v, regexp_replace(base, '\.[^.]*$', '') AS stem, substr(regexp_extract(base, '(\.[^.]*)$', 1), 1, 10) AS ext FROM o),
s AS (SELECT *, replace(regexp_replace(lower(replace(replace(replace(replace(stem, 'C++', 'c-plus-plus'), '(', ''), ')', ''), '.', '')), '-+', '-', 'g'), ' ', '-') AS slug FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, slug, ext ORDER BY ord) AS nth FROM s)
SELECT page_id, ord, '../attachments/guide-to-it/' || slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END || ext AS local FROM r"""
)
def asset_local_names(spark, d):
    ship(spark)
    i = F.col("event_id")
    a = table(spark, d, "events").select(F.col("user_id").alias("page_id"), F.lit("Guide to It").alias("title"), F.concat(F.lit("https://h.example/v"), i % 2, F.lit("/"), picked(ASSETS, i)).alias("url"), i.alias("ord"))
    return html.asset_names(a).select("page_id", "ord", "local")


V1_ERRORS = ("falhou apos 3 tentativas", "gave up, 12 attempts", "timeout", "0 attempts", "Attempt 5 attempts: 7 TENTATIVAS")


def _manifests(spark, d) -> DataFrame:
    """Job documents of several versions: nation n is a job whose pages are its suppliers."""
    s = table(spark, d, "supplier")
    k, url = F.col("s_suppkey"), F.concat(F.lit("u"), F.col("s_suppkey"))
    old = F.concat(F.lit('"'), url, F.lit('":"'), picked(V1_ERRORS, k), F.lit('"'))
    new = F.concat(F.lit('"'), url, F.lit('":{"error":"e'), k, F.lit('","attempts":'), k % 6, F.lit(',"last_attempt":"t"}'))
    failed = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.when(k % 3 == 0, F.when(F.col("s_nationkey") % 2 == 0, old).otherwise(new)))), ","), F.lit("}"))
    done = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.when(k % 3 == 1, F.concat(F.lit('"'), url, F.lit('":{"filename":"f'), k, F.lit('.pdf"}'))))), ","), F.lit("}"))
    g = s.groupBy("s_nationkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: F.concat(F.lit("u"), x))).alias("urls"), failed.alias("failed"), done.alias("done"))
    n = F.col("s_nationkey")
    version = F.when(n % 5 == 4, F.lit('"version":9,')).when(n % 2 == 0, F.lit('"version":1,')).otherwise(F.lit('"version":2,'))
    body = F.concat(F.lit("{"), version, F.when(n % 7 == 6, F.lit("")).otherwise(F.concat(F.lit('"mapped_urls":'), "urls", F.lit(","))), F.lit('"crawl_complete":true,"exported":'), "done", F.lit(',"failures":'), "failed", F.lit("}"))
    return manifest.parse_manifests(g.select(F.format_string("job%02d", n).alias("dir"), body.alias("json")))


_JOB_OK = "s_nationkey % 5 <> 4 AND s_nationkey % 7 <> 6"


@query(
    rf"""WITH f AS (SELECT printf('job%02d', s_nationkey) AS dir, 'u' || s_suppkey AS url, s_nationkey % 2 = 0 AS old, s_suppkey AS k, {listed(V1_ERRORS)}[s_suppkey % 5 + 1] AS e FROM supplier WHERE s_suppkey % 3 = 0 AND {_JOB_OK})
SELECT dir, url, CASE WHEN old THEN e ELSE 'e' || k END AS error, CAST(CASE WHEN old THEN greatest(1, coalesce(TRY_CAST(regexp_extract(e, '(?i)(\d+)\s*(?:tentativa|attempt)', 1) AS INTEGER), 1)) ELSE k % 6 END AS INTEGER) AS attempts FROM f"""
)
def manifest_failures(spark, d):
    return manifest.failures(_manifests(spark, d)).select("dir", "url", "error", "attempts")


@query(f"SELECT printf('job%02d', s_nationkey) AS dir, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS idx, 'u' || s_suppkey AS url FROM supplier WHERE {_JOB_OK}")
def manifest_pages(spark, d):
    return manifest.mapped(_manifests(spark, d)).select("dir", "idx", "url")


@query(f"SELECT printf('job%02d', s_nationkey) AS dir, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS idx, 'u' || s_suppkey AS url FROM supplier WHERE {_JOB_OK}")
def snapshot_pages(spark, d):
    """The pages of the newest version, after the jobs were saved in two updates, the second one against a rival."""
    m, root = _manifests(spark, d), stage_path(spark, "snapshots")
    part = lambda k: m.where(F.substring("dir", 4, 2).cast("int") % 2 == k)
    rivals = iter([lambda: manifest.update_snapshot(spark, root, m.schema, lambda old: old)])

    def second(old):
        for rival in rivals:
            rival()
        return old.union(part(1))

    manifest.update_snapshot(spark, root, m.schema, lambda old: old.union(part(0)))
    manifest.update_snapshot(spark, root, m.schema, second)
    return manifest.mapped(manifest.read_snapshot(spark, manifest.latest_snapshot(spark, root), m.schema)).select("dir", "idx", "url")


_EVENT_URL = "CASE event_id % 3 WHEN 0 THEN 'https://h.example/display/public/S/p' || event_id % 40 WHEN 1 THEN 'https://h.example/display/S/p' || event_id % 40 ELSE 'u' || event_id % 120 END"


@query(
    rf"""WITH e AS (SELECT printf('job%02d', user_id % 25) AS dir, event_id AS seq, {_EVENT_URL} AS url, event_type IN ('purchase', 'view') AS done, event_type AS error FROM events),
k AS (SELECT *, replace(url, '/display/public/', '/display/') AS key FROM e WHERE dir IN (SELECT DISTINCT printf('job%02d', s_nationkey) FROM supplier WHERE {_JOB_OK})),
last AS (SELECT dir, key, max(seq) AS fin, max_by(url, seq) AS url FROM k WHERE done GROUP BY dir, key),
x AS (SELECT printf('job%02d', s_nationkey) AS dir, s_nationkey % 2 = 0 AS old, 'u' || s_suppkey AS url, s_suppkey AS k, s_suppkey % 3 AS r, {listed(V1_ERRORS)}[s_suppkey % 5 + 1] AS e FROM supplier WHERE {_JOB_OK}),
was AS (SELECT dir, url, CASE WHEN old THEN e ELSE 'e' || k END AS error, CASE WHEN old THEN [3, 12, 1, 1, 5][k % 5 + 1] ELSE k % 6 END AS attempts FROM x WHERE r = 0),
n AS (SELECT k.dir, k.url, count(*) AS n, max_by(error, seq) AS error FROM k LEFT JOIN last ON k.dir = last.dir AND k.key = last.key WHERE NOT done AND (fin IS NULL OR seq > fin) GROUP BY ALL),
kept AS (SELECT * FROM was WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.dir = was.dir AND last.key = was.url))
SELECT dir, 'exported' AS kind, url, 'f' || fin || '.pdf' AS filename, NULL AS error, NULL AS attempts FROM last
UNION ALL SELECT dir, 'exported', url, 'f' || k || '.pdf', NULL, NULL FROM x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM last WHERE last.dir = x.dir AND last.key = x.url)
UNION ALL SELECT coalesce(kept.dir, n.dir), 'failed', coalesce(kept.url, n.url), NULL, coalesce(n.error, kept.error), CAST(coalesce(attempts, 0) + coalesce(n, 0) AS INTEGER) FROM kept FULL JOIN n ON kept.dir = n.dir AND kept.url = n.url"""
)
def recorded_events(spark, d):
    """A log merged into the job documents in two batches, the second of which brings events of the first again."""
    none = lambda kind: F.lit(None).cast(kind)
    e = table(spark, d, "events").select(
        F.format_string("job%02d", F.col("user_id") % 25).alias("dir"), F.col("event_id").alias("seq"), F.expr(_EVENT_URL).alias("url"), F.when(F.col("event_type").isin("purchase", "view"), "done").otherwise("failed").alias("event"),
        F.concat(F.lit("f"), "event_id", F.lit(".pdf")).alias("filename"), none("string").alias("title"), none("long").alias("size_bytes"), none("double").alias("elapsed_seconds"), none("string").alias("sha256"), F.col("event_type").alias("error"), F.col("ts").cast("string").alias("at"),
    )
    m = _manifests(spark, d).select("dir", "exported", "failures")
    m = stage(recording.record(m, e.where("seq < 400")), "recorded")
    m = stage(recording.record(m, e.where("seq >= 300")), "recorded")
    done = manifest.exported(m).select("dir", F.lit("exported").alias("kind"), "url", "filename", none("string").alias("error"), none("int").alias("attempts"))
    return done.union(manifest.failures(m).select("dir", F.lit("failed"), "url", none("string"), "error", "attempts"))


@query(
    f"""WITH p AS (SELECT printf('job%02d', s_nationkey) AS dir, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS idx, 'u' || s_suppkey AS url, s_suppkey % 3 AS r, s_nationkey % 2 = 0 AS old, s_suppkey AS k FROM supplier WHERE {_JOB_OK}),
t AS (SELECT *, CASE WHEN old THEN [3, 12, 1, 1, 5][k % 5 + 1] ELSE k % 6 END AS tries FROM p)
SELECT 'auto' AS mode, dir, CAST(idx AS INTEGER) AS idx, url FROM t WHERE r = 2 UNION ALL SELECT 'retry', dir, CAST(idx AS INTEGER), url FROM t WHERE r = 0 AND tries < 5 UNION ALL SELECT 'all', dir, CAST(idx AS INTEGER), url FROM t"""
)
def resume_plans(spark, d):
    m = _manifests(spark, d)
    parts = [commands.resume_plan(m, mode).select(F.lit(mode).alias("mode"), "dir", "idx", "url") for mode in ("auto", "retry", "all")]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    f"""WITH e AS (SELECT s_nationkey, printf('job%02d', s_nationkey) AS dir, 'f' || s_suppkey || '.pdf' AS filename, row_number() OVER (PARTITION BY s_nationkey ORDER BY 'u' || s_suppkey) AS ord, s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 1 AND {_JOB_OK})
SELECT dir, filename, CASE WHEN k % 4 = 0 THEN 'missing' ELSE 'skipped' END AS result FROM e WHERE ord <= 2"""
)
def verify_first(spark, d):
    m = _manifests(spark, d)
    files = manifest.exported(m).where("try_cast(regexp_extract(filename, '([0-9]+)', 1) as int) % 4 <> 0").select("dir", "filename", F.lit(1).alias("size"), F.lit("x").alias("sha256"))
    return commands.verify(m, files, 2)


HEADS = ("%PDF-1.7\n", "%pdf-1.7\n", "%PDF-<HTML>", "%PDF-<!DocType", "<html>%PDF-", "%PDF-1.4 long head <html>", "\n%PDF-1.7")
ENDS = ("%%EOF", "%%EOF" + " " * 1018, "%%EOF" + " " * 1020, "%%eof", "")


@query(
    rf"""WITH c AS (SELECT event_id, {listed(HEADS)}[event_id % 7 + 1] || repeat('x', 3020 + (event_id // 35) % 90) || {listed(ENDS)}[(event_id // 7) % 5 + 1] AS c FROM events),
h AS (SELECT event_id, c, substr(c, 1, 16) AS head FROM c)
SELECT 'f' || event_id AS filename, length(c) AS length, length(c) >= 3072 AND starts_with(head, '%PDF-') AND NOT contains(lower(head), '<html') AND NOT contains(lower(head), '<!doctype') AND contains(right(c, 1024), '%%EOF') AS valid, sha256(c) AS sha256 FROM h"""
)
def pdf_checks(spark, d):
    i = F.col("event_id")
    body = F.concat(picked(HEADS, i), F.expr("repeat('x', cast(3020 + floor(event_id / 35) % 90 as int))"), picked(ENDS, F.floor(i / 7)))
    f = table(spark, d, "events").select(F.concat(F.lit("file:/x/f"), i).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return stored.checked_files(f.withColumn("length", F.length("content").cast("long"))).select("filename", F.col("length").cast("long").alias("length"), "valid", "sha256")


LINES = ("# head", "", "  h{}:81 ", "http://H{}:81", "socks://s{}", "direct", "ftp://f{}", "h{}:99999", "https://u:p@t{}")


@query(
    f"""WITH l AS (SELECT event_id AS n, event_id % 9 AS k, CAST(event_id % 50 AS VARCHAR) AS i FROM events),
e AS (SELECT n, CASE k WHEN 2 THEN 'http://h' || i || ':81' WHEN 3 THEN 'http://h' || i || ':81' WHEN 4 THEN 'socks5://s' || i || ':1080' WHEN 8 THEN 'https://u:p@t' || i || ':443' END AS exit, CASE k WHEN 6 THEN 'ftp://f' || i WHEN 7 THEN 'h' || i || ':99999' END AS refused FROM l WHERE k NOT IN (0, 1, 5))
SELECT min(n) AS n, exit, false AS bad FROM e WHERE exit IS NOT NULL GROUP BY exit UNION ALL SELECT n, refused, true FROM e WHERE exit IS NULL"""
)
def exit_list_lines(spark, d):
    i = F.col("event_id")
    return stored.exit_list(table(spark, d, "events").select(i.alias("n"), F.replace(picked(LINES, i), F.lit("{}"), (i % 50).cast("string")).alias("line")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'flag' WHEN event_id % 3 = 0 THEN 'file' WHEN event_id % 5 = 0 THEN 'env' ELSE 'direct' END AS source FROM events")
def exit_sources(spark, d):
    i = F.col("event_id")
    given = lambda k, n: F.when(i % k == 0, n).when(i % 7 == 0, "")
    return table(spark, d, "events").select("event_id", stored.exit_source(given(2, "flag"), given(3, "file"), given(5, "env")).alias("source"))


# --- maps and reports -----------------------------------------------------------------------------------


@query(
    JOB_SQL
    + """SELECT 'valid' AS gate, CASE WHEN idx % 7 = 0 THEN 'added' WHEN idx % 5 = 0 THEN 'removed' ELSE 'unchanged' END AS change, count(*) AS n FROM mapped WHERE NOT (idx % 7 = 0 AND idx % 5 = 0) GROUP BY 2"""
)
def map_diff_gated(spark, d):
    """A diff that counts, and diffs that say nothing: not forced, old or new map not complete, old map empty."""
    m = job(spark, d)[0]
    old, new = m.where("idx % 7 <> 0"), m.where("idx % 5 <> 0")
    gates = {"valid": (old, True, True, True), "not forced": (old, False, True, True), "old": (old, True, False, True), "new": (old, True, True, False), "empty": (old.where("false"), True, True, True)}
    out = None
    for name, (before, *said) in gates.items():
        one = jobstate.gated_map_diff(before, new, *said).select(F.lit(name).alias("gate"), "change")
        out = one if out is None else out.union(one)
    return out.groupBy("gate", "change").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT event_id, event_id % 3 AS n_new, (event_id // 3) % 2 AS n_pending, CASE (event_id // 6) % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 5 END AS n_old, (event_id // 24) % 2 = 1 AS limited FROM events)
SELECT event_id, CASE WHEN n_new > 0 AND n_pending = 0 THEN CASE WHEN n_old > 1 AND n_new = 1 THEN 'keep' ELSE 'replace' END WHEN n_old IS NOT NULL AND NOT limited THEN 'keep' ELSE 'partial' END AS outcome FROM c"""
)
def remap_outcomes(spark, d):
    i = F.col("event_id")
    at = lambda k, m: F.pmod(F.floor(i / k), F.lit(m))
    old = F.element_at(F.array(F.lit(None).cast("int"), F.lit(0), F.lit(1), F.lit(5)), (at(6, 4) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", jobstate.remap_outcome(i % 3, at(3, 2), old, at(24, 2) == 1).alias("outcome"))


@query(
    JOB_SQL
    + """SELECT (SELECT count(*) FROM mapped) AS mapped, (SELECT count(*) FROM events WHERE event_type = 'view') AS navigations, (SELECT count(*) FROM events WHERE event_type = 'click') AS requests,
(SELECT count(*) FROM mapped WHERE idx % 4 = 1) AS leaves, (SELECT count(*) FROM exported WHERE elapsed_seconds >= 30) AS slow, (SELECT count(*) FROM mapped WHERE idx % 9 = 0) AS pending"""
)
def crawl_summary(spark, d):
    m, e, _ = job(spark, d)
    leaves = m.where("idx % 4 = 1").select("url").union(m.limit(1).select(F.lit("elsewhere").alias("url")))
    asked = table(spark, d, "events").select(F.when(F.col("event_type") == "view", "navigation").when(F.col("event_type") == "click", "listing").alias("kind"))
    return jobstate.crawl_summary(m, leaves, e.where("elapsed_seconds >= 30"), m.where("idx % 9 = 0"), asked)


@query("SELECT event_type AS run, count(*) FILTER (WHERE event_id % 3 = 0) AS blocks, sum((event_id % 10)::DOUBLE) AS waited FROM events GROUP BY event_type")
def merged_worker_metrics(spark, d):
    i = F.col("event_id")
    w = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 16).alias("worker")).agg(F.count_if(i % 3 == 0).alias("blocks"), F.sum((i % 10).cast("double")).alias("waited"))
    return jobstate.merged_metrics(w, ["run"])


@query(
    """WITH q AS (SELECT 0 AS k, page_id AS ord, url FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT 1, page_id, url FROM pages WHERE page_id % 7 = 0),
first AS (SELECT url, min(k * 1000000000 + ord) AS place FROM q GROUP BY url), seen AS (SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0 AND url NOT IN (SELECT url FROM first))
SELECT 'queue' AS state, url, row_number() OVER (ORDER BY place) AS nth FROM (SELECT url, place FROM first UNION ALL SELECT 'https://start.example/', -1) UNION ALL SELECT 'seen', url, NULL FROM seen"""
)
def crawl_restore(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("ord"), "url")
    seen, queue = traverse.restore(p.where("ord % 2 = 0").select("url").distinct(), p.where("ord % 5 = 0"), p.where("ord % 7 = 0"), "https://start.example/")
    return global_ordinal(queue, [F.col("k"), F.col("ord")], "nth").select(F.lit("queue").alias("state"), "url", "nth").union(seen.select(F.lit("seen"), "url", F.lit(None).cast("long")))


ROUGH = (" a\r\nb ", "c\nd\t", " e", "f,\"g\"", "", None, "h\r\ri")


@query(
    rf"""SELECT event_id, regexp_replace(replace(replace({listed(ROUGH)}[event_id % 7 + 1], chr(13), ' '), chr(10), ' '), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS title FROM events"""
)
def csv_texts(spark, d):
    return consolidate.csv_ready(table(spark, d, "events").select("event_id", picked(ROUGH, F.col("event_id")).alias("title")))


@query(
    JOB_SQL
    + """SELECT 'summary' AS part, CAST(0 AS BIGINT) AS idx, '{"pages":' || count(*) || ',"failed":' || count(*) FILTER (WHERE status = 'failed') || '}' AS json FROM report
UNION ALL SELECT 'row', idx, '{"idx":' || idx || ',"url":"' || url || '","status":"' || status || '","attempts":' || attempts || '}' FROM report"""
)
def json_report(spark, d):
    rows = jobstate.report_rows(*job(spark, d)).select("idx", "url", "status", "attempts")
    return consolidate.json_report(rows.agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "failed").alias("failed")), rows)


# --- machines -------------------------------------------------------------------------------------------

_OUTCOMES = "CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'ok' ELSE 'failed' END WHEN 'error' THEN 'failed' WHEN 'view' THEN 'blocked' WHEN 'click' THEN 'transient' ELSE CASE WHEN event_id % 13 = 0 THEN 'permanent' ELSE 'timeout' END END"


@query(
    f"""WITH RECURSIVE {_TURNS}, s AS (
SELECT user_id, CAST(0 AS BIGINT) AS r, 'open' AS state, 1 AS round, 0 AS tries, 0 AS attempts, 0.0::DOUBLE AS paused, false AS lenient FROM (SELECT DISTINCT user_id FROM events)
UNION ALL
SELECT user_id, r, CASE WHEN NOT live THEN state WHEN o = 'ok' THEN 'done' WHEN o = 'permanent' THEN 'permanent' WHEN NOT again AND round = 3 THEN 'failed' ELSE 'open' END,
 CASE WHEN live AND ends AND round < 3 THEN round + 1 ELSE round END, CASE WHEN NOT live THEN tries WHEN ends AND round < 3 THEN 0 ELSE n END, attempts + live::INT,
 CASE WHEN live AND again AND o IN ('transient', 'failed') THEN paused + least(20.0::DOUBLE, 4.0::DOUBLE * n) ELSE paused END, CASE WHEN live THEN n >= 3 OR last ELSE lenient END
FROM (SELECT *, NOT again AND o NOT IN ('ok', 'permanent') AS ends FROM (
 SELECT *, NOT last AND (o IN ('blocked', 'transient') OR (o = 'failed' AND n < 2) OR (o = 'timeout' AND at_exit)) AS again FROM (
  SELECT t.user_id, t.r, {_OUTCOMES} AS o, event_id % 2 = 0 AS at_exit, s.state, s.state = 'open' AS live, s.round, s.tries, s.tries + 1 AS n, s.tries + 1 >= [4, 2, 2][s.round] AS last, s.attempts, s.paused, s.lenient
  FROM s JOIN t ON t.user_id = s.user_id AND t.r = s.r + 1)))
)
SELECT user_id, state, round, tries, attempts, paused, lenient FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS z FROM s) WHERE z = 1"""
)
def retry_rounds(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.expr(_OUTCOMES).alias("outcome"), (F.col("event_id") % 2 == 0).alias("at_exit"))
    return pacing.retry_rounds(e, "user_id")


@query(
    f"""WITH RECURSIVE {_TURNS}, s AS (
SELECT user_id, CAST(0 AS BIGINT) AS r, -1e18::DOUBLE AS until, -1e18::DOUBLE AS since, CAST([] AS DOUBLE[]) AS recent, 0 AS bans, 0 AS pokes, 0 AS late FROM (SELECT DISTINCT user_id FROM events)
UNION ALL
SELECT user_id, r, CASE WHEN over THEN sec + 5e5 ELSE until END, CASE WHEN over THEN sec ELSE since END, CASE WHEN over THEN [] WHEN banned OR NOT counted THEN recent ELSE now END,
 bans + over::INT, pokes + banned::INT, late + (banned AND sec - since > 1e5)::INT
FROM (SELECT *, NOT banned AND counted AND len(now) > 2 AS over FROM (
 SELECT t.user_id, t.r, t.sec, event_type <> 'view' AS counted, s.until, s.since, s.recent, s.bans, s.pokes, s.late, s.until > t.sec AS banned, list_append(list_filter(s.recent, lambda x: x >= t.sec - 4e5), t.sec) AS now
 FROM s JOIN t ON t.user_id = s.user_id AND t.r = s.r + 1)))
SELECT user_id, bans, pokes, late AS late_pokes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS z FROM s) WHERE z = 1"""
)
def request_bans(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    e = table(spark, d, "events").select("user_id", t.alias("t"), F.col("event_id").alias("seq"), (F.col("event_type") != "view").alias("counted"))
    return pacing.request_bans(e, "user_id", 4e5, 2, 5e5, 1e5)


_KIND = "CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'ok' ELSE 'error' END WHEN 'error' THEN 'error' WHEN 'view' THEN 'block' WHEN 'click' THEN 'block' ELSE CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'block' END END"


@query(
    f"""WITH t AS (SELECT user_id, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
n AS (SELECT *, count(*) FILTER (WHERE kind = 'block') OVER w AS blocks, count(*) FILTER (WHERE kind = 'error') OVER w AS errors, count(*) FILTER (WHERE kind = 'timeout') OVER w AS timeouts FROM t WINDOW w AS (PARTITION BY user_id ORDER BY r)),
e AS (SELECT *, CASE WHEN kind = 'ok' THEN 'done' WHEN blocks >= 8 THEN 'stop' WHEN errors >= 4 THEN 'pending' WHEN timeouts >= 2 THEN 'gave up' ELSE 'open' END AS state FROM n),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY state = 'open', CASE WHEN state = 'open' THEN -r ELSE r END) AS z FROM e)
SELECT user_id, state, CAST(blocks AS INTEGER) AS blocks, CAST(errors AS INTEGER) AS errors, CAST(timeouts AS INTEGER) AS timeouts FROM z WHERE z = 1"""
)
def node_retry_states(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"))
    return pacing.node_retries(e, "user_id")


# --- classification over mixed inputs -------------------------------------------------------------------


def holds(column: str, markers: tuple) -> str:
    """In SQL: whether a text holds one of the markers."""
    return "(" + " OR ".join(f"contains({column}, {literal(m)})" for m in markers) + ")"


CODES = ("200", "204", "429", "503", "403", "522", "404", None)
MARKS = (None, "challenge", "Challenge", "", "block")
TITLES = ("Docs", "Just a moment...", "ACCESS DENIED | Cloudflare", None, "Attention Required! | Cloudflare", "Error 1015", "")
BODIES = ("hello", "You are being rate limited", "Verifying you are human", "Sorry, you have been blocked - Cloudflare", "cloudflare Ray", None, "error code: 1015", "cf-error-details", "Access Denied by Cloudflare", "error code: 1009 cloudflare")


@query(
    f"""WITH e AS (SELECT event_id, CAST({listed(CODES)}[event_id % 8 + 1] AS INTEGER) AS s, lower(coalesce({listed(MARKS)}[event_id // 8 % 5 + 1], '')) AS m,
 lower(coalesce({listed(TITLES)}[event_id // 3 % 7 + 1], '')) AS t, lower(coalesce({listed(BODIES)}[event_id // 7 % 10 + 1], '')) AS b, event_id % 11 = 0 AS page FROM events),
x AS (SELECT *, t || chr(10) || b AS x, coalesce(s BETWEEN 200 AND 299, false) AS ok FROM e)
SELECT event_id, CASE WHEN s = 429 THEN 'rate-limit' WHEN m = 'challenge' THEN 'challenge' WHEN ok AND page THEN NULL WHEN ok AND NOT {holds("t", classify.CDN_TITLES)} THEN NULL
 WHEN {holds("x", classify.RATE_MARKERS)} THEN 'rate-limit' WHEN {holds("x", classify.CHALLENGE_MARKERS)} THEN 'challenge' WHEN s >= 500 THEN 'server-error'
 WHEN contains(x, 'cloudflare') AND {holds("x", classify.DENIED_MARKERS)} THEN 'access-denied' END AS kind FROM x"""
)
def response_rules(spark, d):
    i = F.col("event_id")
    at = lambda k: F.floor(i / k)
    kind = classify.response_kind(picked(CODES, i).cast("int"), picked(MARKS, at(8)), picked(TITLES, at(3)), picked(BODIES, at(7)), i % 11 == 0)
    return table(spark, d, "events").select("event_id", kind.alias("kind"))


FAULTS = (
    *(f"net::{m.upper()} at https://h.example/x503y" for m in classify.EXIT_ERRORS + classify.PASSING_ERRORS + ("err_http_response_code_failure",) if m.startswith("err_")),
    *(f"HTTP {c} for page" for c in classify.BLOCKING_CODES), "status 1503", "503", "x503x", "id=5030", "no space left on disk", "Permission denied", "WinError 5", "Chromium crashed", "Timeout\nCall log: 429", "socket hang up", "Proxy Connection failed", "",
)


@query(
    rf"""WITH e AS (SELECT event_id, {listed(FAULTS)}[event_id % {len(FAULTS)} + 1] AS e FROM events),
h AS (SELECT event_id, lower(e) AS whole, lower(regexp_replace(split_part(e, chr(10) || 'Call log:', 1), 'https?://\S+', '<url>', 'g')) AS h FROM e)
SELECT event_id, {holds("h", classify.BLOCKING_MARKERS)} OR regexp_matches(h, '(^|[^0-9])({"|".join(classify.BLOCKING_CODES)})([^0-9]|$)') AS blocking,
 {holds("h", classify.EXIT_ERRORS)} AS at_exit, {holds("h", classify.EXIT_ERRORS + classify.PASSING_ERRORS)} AS passing,
 CASE WHEN {holds("whole", classify.WAIT_WORDS)} THEN 'wait' WHEN {holds("whole", classify.BROWSER_WORDS)} THEN 'browser' WHEN {holds("whole", classify.DISK_WORDS)} THEN 'disk' WHEN {holds("whole", classify.DENIED_WORDS)} THEN 'permission' END AS advice FROM h"""
)
def error_rules(spark, d):
    m = picked(FAULTS, F.col("event_id"))
    return table(spark, d, "events").select("event_id", classify.is_blocking(m).alias("blocking"), classify.is_exit_error(m).alias("at_exit"), classify.is_passing(m).alias("passing"), classify.advice(m).alias("advice"))


LOGIN_AT = ("https://h.example/login.action?os=1", "https://h.example/LoginPage", "https://h.example/doLogin", "https://h.example/a", "", None, "https://h.example/blog-in")
LOGIN_NAMES = ("Log In - Wiki", "Sign in", "Entrar", "Docs", None, "Blogging", "")


@query(
    f"""WITH e AS (SELECT event_id, lower(coalesce({listed(LOGIN_AT)}[event_id % 7 + 1], '')) AS u, event_id // 7 % 3 = 0 AS form, lower(coalesce({listed(LOGIN_NAMES)}[event_id // 5 % 7 + 1], '')) AS t FROM events)
SELECT event_id, CASE WHEN {holds("u", classify.LOGIN_URLS)} THEN 2 WHEN form THEN 2 WHEN {holds("t", classify.LOGIN_TITLES)} THEN 1 ELSE 0 END AS score FROM e"""
)
def login_rules(spark, d):
    i = F.col("event_id")
    score = classify.login_score(picked(LOGIN_AT, i), F.pmod(F.floor(i / 7), F.lit(3)) == 0, picked(LOGIN_NAMES, F.floor(i / 5)))
    return table(spark, d, "events").select("event_id", score.alias("score"))


EXITS = ("host", "HOST:81", "http://h", "https://h:8443/", "socks://s", "socks5h://s:1", "socks4a://s", "socks5://u:p@s", "http://u:p@h:8080", "h:8080:u:p", "h:8080:u@x:p w", "direct", "NONE", "", "  ", "ftp://h", "http://h:0", "http://h:65536", "http://[::1]:80", "http://h/path", "h:port", None)
_X = r"'^([^:/?#]+)://(?:([^:@/]*)(?::([^@/]*))?@)?(\[[^\]]+\]|[^:/?#@]+)(?::([0-9]+))?/?$'"


@query(
    rf"""WITH e AS (SELECT event_id, trim({listed(EXITS)}[event_id % {len(EXITS)} + 1]) AS r FROM events),
f AS (SELECT event_id, r, CASE WHEN NOT contains(r, '://') AND regexp_matches(r, '^([^:@/\[]+):([0-9]+):([^:]+):(.+)$')
  THEN 'http://' || url_encode(split_part(r, ':', 3)) || ':' || replace(url_encode(split_part(r, ':', 4)), '%20', '+') || '@' || split_part(r, ':', 1) || ':' || split_part(r, ':', 2) WHEN contains(r, '://') THEN r ELSE 'http://' || r END AS v FROM e),
p AS (SELECT *, lower(regexp_extract(v, {_X}, 1)) AS s0, regexp_extract(v, {_X}, 2) AS u, regexp_extract(v, {_X}, 3) AS pw, lower(regexp_extract(v, {_X}, 4)) AS h, regexp_extract(v, {_X}, 5) AS port FROM f),
s AS (SELECT *, CASE s0 WHEN 'socks5h' THEN 'socks5' WHEN 'socks' THEN 'socks5' WHEN 'socks4a' THEN 'socks4' ELSE s0 END AS s FROM p),
n AS (SELECT *, coalesce(TRY_CAST(nullif(port, '') AS INTEGER), CASE s WHEN 'http' THEN 80 WHEN 'https' THEN 443 WHEN 'socks5' THEN 1080 WHEN 'socks4' THEN 1080 END) AS n FROM s)
SELECT event_id, CASE WHEN r <> '' AND lower(r) NOT IN ('direct', 'direto', 'none', 'sem-proxy') AND regexp_matches(v, {_X}) AND s IN ('http', 'https', 'socks5', 'socks4') AND n BETWEEN 1 AND 65535 AND NOT (s LIKE 'socks%' AND u <> '')
 THEN s || '://' || CASE WHEN u <> '' THEN u || CASE WHEN pw <> '' THEN ':' || pw ELSE '' END || '@' ELSE '' END || h || ':' || n END AS exit FROM n"""
)
def exit_rules(spark, d):
    return table(spark, d, "events").select("event_id", urls.exit_url(picked(EXITS, F.col("event_id"))).alias("exit"))
