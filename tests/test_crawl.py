from collections import deque
from random import Random

from pagegraph.operators import crawl

EDGES = "parent string, ord long, child string, is_leaf boolean, page_id string, via string"


def queue_run(edges, roots, max_pages=None):
    """A queue, node by node: (mapped, queue, page ids, leaves, seen)."""
    lists = {}
    for p, o, c, leaf, pid, via in sorted(edges, key=lambda x: (x[0], x[1])):
        lists.setdefault(p, []).append((c, leaf, pid, via))
    queue, mapped, seen, ids, leaves = deque(roots), [], set(), {}, set()
    while queue:
        n = queue.popleft()
        seen.add(n)
        mapped.append(n)
        if max_pages and len(mapped) >= max_pages:
            seen.discard(n)
            queue.appendleft(n)
            break
        if n in leaves:
            continue
        if "pageId=" in n:
            ids.setdefault(n, n.split("pageId=")[1])
        own = ids.get(n)
        for c, leaf, pid, via in lists.get(n, []):
            if via is not None and via != own:
                continue
            if pid:
                ids.setdefault(c, pid)
            if leaf:
                leaves.add(c)
            if c not in seen and c not in queue:
                queue.append(c)
    return mapped, list(queue), ids, leaves, seen


def graphs(seed, n, vias=True):
    """n disjoint graphs with flags and ids that contradict each other."""
    r, edges, roots = Random(seed), [], []
    for g in range(n):
        k = r.randint(2, 12)
        name = [f"https://h/{g}/{i}" + (f"?pageId={i % 3}" if r.random() < 0.2 else "") for i in range(k)]
        roots.append(name[0])
        at = {}
        for _ in range(r.randint(k, 4 * k)):
            p = r.choice(name)
            at[p] = at.get(p, 0) + r.randint(1, 2)
            via = r.choice((None, None, None, "0", "1")) if vias else None
            edges.append((p, at[p], r.choice(name), r.choice((None, False, False, True)), r.choice((None, None, "0", "1")), via))
    return edges, roots


def rows(df):
    return [tuple(r) for r in df.collect()]


def state_of(spark, roots):
    return crawl.State.start(spark.createDataFrame(list(enumerate(roots)), "ord long, url string"))


def test_equals_a_queue_on_1000_graphs(spark):
    edges, roots = graphs(1, 1000)
    got = crawl.crawl(spark.createDataFrame(edges, EDGES), state_of(spark, roots))
    assert got.complete
    order, ids, leaves = rows(got.mapped), dict(rows(got.page_ids)), {r[0] for r in rows(got.leaves)}
    assert sorted(i for i, _ in order) == list(range(1, len(order) + 1))
    of = {}
    for _, u in sorted(order):
        of.setdefault(u.split("/")[3], []).append(u)
    mine_of = {}
    for e in edges:
        mine_of.setdefault(e[0].split("/")[3], []).append(e)
    for g, root in enumerate(roots):
        mine = mine_of[str(g)]
        mapped, _, want, flagged, _ = queue_run(mine, [root])
        assert of[str(g)] == mapped, g
        assert {u: ids[u] for u in set(mapped) & set(ids)} == want, g
        assert set(mapped) & leaves == flagged, g


def test_stopped_anywhere_and_resumed(spark):
    edges, roots = graphs(5, 12)
    df = spark.createDataFrame(edges, EDGES).cache()
    want, _, ids, leaves, _ = queue_run(edges, roots)
    for stops in ([{"max_waves": 1}], [{"max_pages": 3}, {"max_pages": 20}], [{"max_pages": 13}, {"max_waves": 2}]):
        s = state_of(spark, roots)
        for how in stops:
            s = crawl.crawl(df, s, **how).resumed(roots[0])
            if "max_pages" in how:
                mapped, queue, *_, seen = queue_run(edges, roots, how["max_pages"])
                assert [u for _, u in sorted(rows(s.mapped))] == mapped
                assert [u for _, u in sorted(rows(s.queue))] == queue and {r[0] for r in rows(s.seen)} == seen
        s = crawl.crawl(df, s)
        assert [u for _, u in sorted(rows(s.mapped))] == want
        assert dict(rows(s.page_ids)) == ids and {r[0] for r in rows(s.leaves)} == leaves


def test_resume_cleans_what_was_saved(spark):
    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    s = crawl.State(
        t([(1, "http://r"), (2, "http://a"), (3, "http://a"), (4, "no"), (5, "http://b")], "idx long, url string"),
        t([(0, "http://b"), (1, None), (2, "http://c"), (3, "http://b")], "ord long, url string"),
        t([("http://r",), ("http://a",), ("http://b",), ("",)], "url string"),
        t([("http://b",)], "url string"),
        t([], "url string, page_id string"),
    )
    r = s.resumed("http://r", t([(0, "http://a"), (1, "http://c")], "ord long, url string"))
    assert sorted(rows(r.mapped)) == [(1, "http://r"), (2, "http://a"), (3, "http://b")]
    assert sorted(rows(r.queue)) == [(1, "http://b"), (2, "http://c"), (3, "http://a")]
    assert rows(r.seen) == [("http://r",)]
    edges = t([("http://b", 0, "http://x", None, None, None), ("http://a", 0, "http://y", None, None, None)], EDGES)
    done = crawl.crawl(edges, r)
    assert sorted(rows(done.mapped)) == [(1, "http://r"), (2, "http://a"), (3, "http://b"), (4, "http://c"), (5, "http://y")]  # b is a known leaf
    lost = crawl.State(s.mapped, s.queue.where("false"), s.seen.where("false"), s.leaves, s.page_ids).resumed("http://r")
    assert rows(lost.queue) == [(1, "http://r")]


def test_nothing_to_do(spark):
    s = crawl.State.start(spark.createDataFrame([], "ord long, url string"))
    got = crawl.crawl(spark.createDataFrame([], EDGES), s)
    assert not got.complete and not rows(got.mapped) and not rows(got.queue)


def test_a_crawl_takes_listings_of_any_length(spark, tmp_path):
    """4,205 children of one parent: more than 20 listing pages of 200."""
    import duckdb

    from pagegraph.plans import catalogue, crawls

    tables = {
        "region": ("r_regionkey long", [(0,)]),
        "nation": ("n_nationkey long, n_regionkey long", [(0, 0)]),
        "customer": ("c_custkey long, c_nationkey long", [(i, 0) for i in range(4205)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, 4205 - i) for i in range(1, 30)]),
    }
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        at = f"{tmp_path}/{name}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(at)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/*.parquet')")
    got = sorted(map(tuple, crawls.crawl_from_listings(spark, str(tmp_path)).select("url", "idx", "page_id", "is_leaf").collect()))
    assert got == sorted(con.execute(catalogue.ORACLE_SQL["crawl_from_listings"]).fetchall())
    assert len(got) > 4205
