"""Crawl of a page graph from saved state, with what listings say about their children, in queue order.

A queue that takes nodes from its front and appends their unseen children works in waves: the queue as saved, then all
children of it that are new, and so on. A node's position is (wave, path), the path being that of its first
discoverer with the child's ordinal, so each wave is one join with the listings and an anti-join with what
was known before; waves go to one folder, so plans don't grow with them.

What a listing says holds from the moment its parent is taken: a child flagged as a leaf is not listed when its own turn
comes, and a child's page id is that of the first listing to name one. A writer may stand in the wave of its
target, before it, and its own flag may depend on yet earlier nodes. ``_settled`` decides these few nodes by rounds: a
node is settled once all earlier nodes of the wave that may write to it are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..session import Growing, stage
from .ordinal import global_ordinal

EDGES = "parent string, ord long, child string, is_leaf boolean, page_id string, via string"
KNOWN = {"mapped": "idx long, url string", "queue": "ord long, url string", "seen": "url string", "leaves": "url string", "page_ids": "url string, page_id string"}


@dataclass(frozen=True)
class State:
    """mapped(idx, url): nodes in the order in which they were first taken; queue(ord, url): nodes still to be taken;
    seen(url): nodes whose children are queued or known; leaves(url), page_ids(url, page_id): what listings said."""

    mapped: DataFrame
    queue: DataFrame
    seen: DataFrame
    leaves: DataFrame
    page_ids: DataFrame

    @classmethod
    def start(cls, roots: DataFrame, page_ids: DataFrame | None = None) -> State:
        """roots(ord, url), and what is known of their page ids."""
        empty = {k: roots.sparkSession.createDataFrame([], v) for k, v in KNOWN.items()}
        return cls(**empty | {"queue": roots} | ({} if page_ids is None else {"page_ids": page_ids}))

    @property
    def complete(self) -> bool:
        """A map that has nodes and no pending ones."""
        return bool(self.mapped.limit(1).count()) and not self.queue.limit(1).count()

    def saved(self) -> State:
        """The same as tables in the shared folder, cut off from the waves that they come from."""
        return State(**{k: stage(getattr(self, k), f"crawl-{k}") for k in KNOWN})

    def resumed(self, root: str, give_ups: DataFrame | None = None) -> State:
        """What to go on from: queued nodes are not seen; nodes given up (ord, url) come after the queue; the root comes
        first if it is neither; the first of rows that repeat counts, and addresses that aren't HTTP go."""
        spark = self.queue.sparkSession
        http = F.trim("url").rlike("^https?://")
        again = spark.createDataFrame([], KNOWN["queue"]) if give_ups is None else give_ups
        every = self.queue.select(F.lit(0).alias("k"), "ord", "url").union(again.select(F.lit(1), "ord", "url")).where(http)
        every = every.groupBy("url").agg(F.min(F.struct("k", "ord")).alias("at"))
        seen = self.seen.where(http).distinct().join(every.select("url"), "url", "left_anti")
        start = spark.createDataFrame([(root,)], "url string").join(seen.union(every.select("url")), "url", "left_anti")
        every = every.union(start.select("url", F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("ord"))))
        queue = global_ordinal(every, [F.col("at")], "ord").select("ord", "url")
        mapped = self.mapped.where(http).groupBy("url").agg(F.min("idx").alias("at"))
        return State(global_ordinal(mapped, [F.col("at")]).select("idx", "url"), queue, seen, self.leaves.where(http), self.page_ids)


def _known(nodes: DataFrame, state: State) -> DataFrame:
    """nodes(url, path, is_leaf, page_id) with what the saved state says of them; a saved page id comes first."""
    leaves = state.leaves.distinct().select(F.col("url").alias("l"))
    ids = state.page_ids.groupBy(F.col("url").alias("i")).agg(F.min("page_id").alias("saved_id"))
    out = nodes.join(leaves, F.col("url") == F.col("l"), "left").join(ids, F.col("url") == F.col("i"), "left")
    return out.select("url", "path", (F.col("is_leaf") | F.col("l").isNotNull()).alias("is_leaf"), F.coalesce("saved_id", "page_id").alias("page_id"))


def _holds(via: str, page_id: str):
    """Whether a listing is that of the page: by the id that it was asked for, if any."""
    return F.col(via).isNull() | F.coalesce(F.col(via) == F.col(page_id), F.lit(False))


def _settled(wave: DataFrame, touch: DataFrame) -> DataFrame:
    """wave(url, path, is_leaf, page_id, url_id), touch(url, path, child, ord, is_leaf, page_id, via): every listing of
    its nodes -> wave with flags and ids as they are when each node's turn comes."""
    said = touch.where("is_leaf or page_id is not null")
    to = wave.select(F.col("url").alias("child"), F.col("path").alias("to_path"))
    inner = said.join(to, "child").where(F.col("path") < F.col("to_path"))
    inner = stage(inner.select(F.col("url").alias("writer"), "path", "ord", "child", F.coalesce("is_leaf", F.lit(False)).alias("flag"), F.col("page_id").alias("named"), "via"), "crawl-inner")
    if not inner.limit(1).count():
        return wave.withColumn("page_id", F.coalesce("page_id", "url_id"))
    waits = inner.select(F.col("child").alias("w")).distinct()
    now = wave.join(waits, F.col("url") == F.col("w"), "left").withColumn("open", F.col("w").isNotNull()).drop("w")
    now = stage(now.withColumn("page_id", F.when(F.col("open"), F.col("page_id")).otherwise(F.coalesce("page_id", "url_id"))), "crawl-settled")
    while now.where("open").limit(1).count():
        writers = now.select(F.col("url").alias("writer"), F.col("is_leaf").alias("is_idle"), F.col("page_id").alias("own_id"), "open")
        wrote = ~F.col("is_idle") & _holds("via", "own_id")
        first = F.min(F.when(wrote & F.col("named").isNotNull(), F.struct("path", "ord", "named")))["named"]
        ready = inner.join(writers, "writer").groupBy(F.col("child").alias("c")).agg(F.bool_and(~F.col("open")).alias("ready"), F.bool_or(wrote & F.col("flag")).alias("flag"), first.alias("named"))
        one = now.join(ready, F.col("url") == F.col("c"), "left")
        turn = F.col("open") & F.col("ready")
        one = one.select(
            "url",
            "path",
            F.when(turn, F.col("is_leaf") | F.col("flag")).otherwise(F.col("is_leaf")).alias("is_leaf"),
            F.when(turn, F.coalesce("page_id", "named", "url_id")).otherwise(F.col("page_id")).alias("page_id"),
            "url_id",
            (F.col("open") & ~F.col("ready")).alias("open"),
        )
        now = stage(one, "crawl-settled")
    return now.drop("open")


#: Of nodes of which nothing is known.
FRESH = ("cast(null as array<bigint>) as path", "false as is_leaf", "cast(null as string) as page_id")
FOUND = "url string, path array<bigint>, is_leaf boolean, page_id string"
NODES = "url string, wave int, path array<bigint>, is_leaf boolean, page_id string"
SAID = "wave int, path array<bigint>, ord long, child string, is_leaf boolean, page_id string"


def crawl(edges: DataFrame, state: State, max_pages: int | None = None, max_waves: int | None = None) -> State:
    """Go on from ``state`` until nothing is queued, ``max_waves`` waves are done or the map has ``max_pages`` nodes.

    edges(parent, ord, child [, is_leaf, page_id, via]): listings, at most one row for a parent and ord; ``via`` is the
    page id whose listing it is, null if it holds whatever the parent's id. Nodes without edges have no children. The
    node that meets ``max_pages`` is mapped and stays first in the queue. Stopping anywhere and going on gives the map
    of a run without a stop. Null addresses are no nodes; an empty queue changes nothing.
    """
    spark = edges.sparkSession
    have = lambda c, kind: F.col(c).cast(kind) if c in edges.columns else F.lit(None).cast(kind)
    e = edges.where("child is not null").select(F.col("parent").alias("url"), F.col("ord").cast("long").alias("ord"), "child", have("is_leaf", "boolean").alias("is_leaf"), have("page_id", "string").alias("page_id"), have("via", "string").alias("via"))
    state = state.saved()
    nodes, said, known = Growing(spark, "crawl-nodes", NODES), Growing(spark, "crawl-said", SAID), Growing(spark, "crawl-known", FOUND)
    known.add(state.seen.union(state.queue.select("url")).selectExpr("url", *FRESH))
    told = bool(state.leaves.limit(1).count() or state.page_ids.limit(1).count())
    n_mapped, wave = state.mapped.count(), 0
    front = state.queue.where("url is not null").groupBy("url").agg(F.min(F.array("ord")).alias("path")).selectExpr("url", "path", *FRESH[1:])
    rest = end = None  # nodes that were not taken, and the path of the one that meets the bound
    while True:
        if told or not wave:
            front = stage(_known(front, state), "crawl-front")
        n_front = front.count()
        if not n_front:
            break
        if wave == max_waves:
            rest = front
            break
        if max_pages is not None:
            new = front.join(state.mapped.select("url"), "url", "left_anti")
            n_new = new.count()
            if n_mapped + n_new >= max_pages:
                nth = max_pages - n_mapped
                ranked = front.select("path") if nth < 1 else global_ordinal(new.select("path"), [F.col("path")]).where(F.col("idx") == nth)
                end = ranked.agg(F.min("path")).first()[0]  # one path
                stop = F.array(*map(F.lit, end)).cast("array<bigint>")
                rest, front = front.where(F.col("path") >= stop), front.where(F.col("path") < stop)
            n_mapped += n_new
        taken = front.withColumn("url_id", urls.page_id(F.col("url")))
        touch = taken.where("not is_leaf").select("url", "path").join(e, "url")
        touch = stage(touch, "crawl-touch")
        done = nodes.add(_settled(taken, touch).select("url", F.lit(wave).alias("wave"), "path", "is_leaf", "page_id"))
        live = done.where("not is_leaf").select("url", F.col("page_id").alias("own_id"))
        wrote = said.add(touch.join(live, "url").where(_holds("via", "own_id")).select(F.lit(wave).alias("wave"), "path", "ord", "child", "is_leaf", "page_id"))
        at = F.struct("path", "ord")
        found = wrote.groupBy(F.col("child").alias("url")).agg(F.min(at).alias("at"), F.bool_or("is_leaf").alias("is_leaf"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("path", "ord", "page_id")))["page_id"].alias("page_id"))
        found = found.join(known.all().select("url"), "url", "left_anti").select("url", F.concat("at.path", F.array("at.ord")).alias("path"), F.coalesce("is_leaf", F.lit(False)).alias("is_leaf"), "page_id")
        found = known.add(found)
        wave += 1
        if end is not None:
            rest = rest.select("url", F.array(F.lit(0).cast("bigint")).alias("k"), "path").union(found.select("url", F.array(F.lit(1).cast("bigint")), "path"))
            rest = rest.select("url", F.concat("k", "path").alias("path"), F.lit(True).alias("is_leaf"), F.lit(None).cast("string").alias("page_id"))
            break
        front = found
    return _after(state, nodes.all(), said.all(), rest, end is not None)


def _after(state: State, nodes: DataFrame, said: DataFrame, rest: DataFrame | None, met: bool) -> State:
    spark = nodes.sparkSession
    empty = spark.createDataFrame([], "url string, path array<bigint>")
    queue = global_ordinal(empty if rest is None else rest.select("url", "path"), [F.col("path")], "ord").select("ord", "url")
    order = nodes.select("url", "wave", "path")
    if met:  # the node that met the bound is mapped too
        first = queue.where("ord = 1").select("url", F.lit(1 << 30).alias("wave"), F.array().cast("array<bigint>").alias("path"))
        order = order.union(first)
    new = order.join(state.mapped.select("url"), "url", "left_anti")
    n = state.mapped.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("n"))
    new = global_ordinal(new, [F.col("wave"), F.col("path")], "nth").crossJoin(F.broadcast(n)).select((F.col("n") + F.col("nth")).alias("idx"), "url")  # one row
    leaves = state.leaves.union(said.where("is_leaf").select("child")).distinct()
    own = nodes.where("not is_leaf and page_id is not null").select("url", F.struct("wave", "path", F.lit(0).alias("k"), F.lit(0).cast("long").alias("ord"), "page_id").alias("at"))
    named = said.where("page_id is not null").select(F.col("child").alias("url"), F.struct("wave", "path", F.lit(1).alias("k"), "ord", "page_id").alias("at"))
    ids = own.union(named).groupBy("url").agg(F.min("at")["page_id"].alias("page_id"))
    ids = state.page_ids.union(ids.join(state.page_ids.select("url"), "url", "left_anti"))
    return State(state.mapped.union(new), queue, state.seen.union(nodes.select("url")).distinct(), leaves, ids)


def listing_edges(refs: DataFrame, start_url: str, start_id: str | None) -> DataFrame:
    """refs(parent_id, ord, url, page_id, is_leaf), as listings name children -> edges between addresses.

    Children get the canonical address in the display form of the start and are dropped beyond its scope. A listing is
    asked for by id, so its parents are the addresses that some listing, or the address itself, names with that id.
    """
    start = F.lit(start_url)
    public = F.lit("/display/public/" in start_url)
    at = urls.scope(start)
    # staged between, as each step names its address many times and would be worked out anew for each of them
    kids = stage(refs.select("parent_id", "ord", "url", "page_id", "is_leaf"), "crawl-listed").where(urls.is_page_href(F.col("url")))
    kids = stage(kids.withColumn("child", urls.match_form(F.col("url"), public)), "crawl-forms")
    kids = stage(kids.withColumn("child", urls.canonical(F.col("child"))), "crawl-canonical")
    kids = stage(kids.where(urls.in_scope(F.col("child"), at["domain"], at["path_prefix"], at["space_key"])).select("parent_id", "ord", "child", "page_id", "is_leaf"), "crawl-refs")
    own = refs.sparkSession.createDataFrame([(start_url, start_id)], "parent string, via string")
    by_address = kids.select(F.col("child").alias("parent"), urls.page_id(F.col("child")).alias("via"))
    named = kids.select(F.col("child").alias("parent"), F.col("page_id").alias("via")).union(by_address).union(own.select(urls.canonical(F.col("parent")), "via"))
    named = named.where("via is not null").distinct()
    return kids.join(named, F.col("parent_id") == F.col("via")).select("parent", "ord", "child", "is_leaf", "page_id", "via")
