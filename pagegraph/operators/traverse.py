"""Breadth-first traversal of a page graph by levels.

Queue order equals the order by (depth, path), the path being child ordinals along the first discovery. Each
level joins the frontier with the edges, keeps the least path of each child, and drops visited nodes by
anti-join. Levels are staged tables, so plans stay short and lost executors cost only a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Growing
from .ordinal import global_ordinal


def bfs(edges: DataFrame, root: str, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """edges(parent, ord, child [, is_leaf]) -> (node, depth, path): every reachable node once.

    Children of a node known as a leaf are not looked up, so a leaf costs no join work. Levels beyond the one in which
    ``max_nodes`` nodes are met are not looked up either.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["child"]
    leaf = F.col("is_leaf") if "is_leaf" in edges.columns else F.lit(None)
    e = edges.select(F.col("parent").alias("__p"), F.col("ord").cast("long").alias("__o"), F.col("child").alias("node"), leaf.cast("boolean").alias("is_leaf"))
    visited = Growing(spark, "bfs", f"node {kind}, depth int, path array<bigint>, is_leaf boolean")
    first = spark.createDataFrame([(root,)], "node string").select(F.col("node").cast(kind).alias("node"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path"), F.lit(None).cast("boolean").alias("is_leaf"))
    frontier = visited.add(first)
    depth, n = 0, 1
    while (max_depth is None or depth < max_depth) and (max_nodes is None or n < max_nodes):
        depth += 1
        open_ = frontier.where("is_leaf is distinct from true").select(F.col("node").alias("__n"), "path")
        found = open_.join(e, F.col("__n") == F.col("__p")).groupBy("node").agg(F.min(F.concat("path", F.array("__o"))).alias("path"), F.bool_or("is_leaf").alias("is_leaf"))
        new = found.join(visited.all().select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "path", "is_leaf")
        frontier = visited.add(new)
        n_new = frontier.count()
        if not n_new:
            break
        n += n_new
    return visited.all().select("node", "depth", "path")


def ordered(nodes: DataFrame) -> DataFrame:
    """Adds idx, the 1-based position in queue order."""
    return global_ordinal(nodes, [F.col("depth"), F.col("path")])


def bounded(nodes: DataFrame, max_pages: int) -> DataFrame:
    """The first max_pages of ordered nodes; the one that meets the bound is mapped but stays pending."""
    return nodes.where(F.col("idx") <= max_pages).withColumn("pending", F.col("idx") == max_pages)


def crawl_status(mapped: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: complete if the map has rows and nothing is pending."""
    m, p = mapped.agg(F.count("*").alias("n_mapped")), pending.agg(F.count("*").alias("n_pending"))
    return m.crossJoin(p).select("n_mapped", "n_pending", ((F.col("n_mapped") > 0) & (F.col("n_pending") == 0)).alias("complete"))


def restore(seen: DataFrame, queue: DataFrame, give_ups: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Saved state -> (seen, queue) to resume from: queued nodes are not seen, nodes given up are queued
    again, the root comes first if nothing else is left, first positions win. Tables have (ord, url)."""
    spark = queue.sparkSession
    every = queue.select(F.lit(0).alias("k"), "ord", "url").union(give_ups.select(F.lit(1), "ord", "url"))
    every = every.groupBy("url").agg(F.min(F.struct("k", "ord")).alias("at")).select(F.col("at.k").alias("k"), F.col("at.ord").alias("ord"), "url")
    seen = seen.join(every.select("url"), "url", "left_anti")
    start = spark.createDataFrame([(root,)], "url string").join(seen.select("url"), "url", "left_anti").join(every.select("url"), "url", "left_anti")
    return seen, every.union(start.select(F.lit(-1), F.lit(0).cast("long"), "url")).orderBy("k", "ord")
