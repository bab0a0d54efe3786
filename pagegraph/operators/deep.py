"""Breadth-first order of a tree in rounds that grow with the logarithm of its depth.

Level by level, a chain of a million pages would take a million joins. Here every node jumps to an ancestor twice as
far in each round, and paths, the ordinals from the root down, are compared by ranks as in prefix doubling: the rank of a
segment of 2 ** (k + 1) ordinals is that of the pair of ranks of its halves. Nodes of one depth have segments of one
length in every round, so their ranks compare; no path is ever written out, and a row stays a few numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ordinal import global_ordinal


def tree_order(edges: DataFrame, root: str) -> DataFrame:
    """edges(parent, ord, child) of a tree -> (node, depth, idx): every node below root, and root itself, with its
    1-based position in the order of a queue.

    An edge that repeats counts once, with its least ord; a child of two parents is an error. Edges to the root, and nodes
    that no path from the root reaches, in circles of their own too, give no row. Ties of ord among the children of a
    node are broken by the child.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["child"]
    own = edges.where((F.col("child") != F.lit(root)) & F.col("parent").isNotNull()).groupBy("child").agg(F.min("parent").alias("up"), F.max("parent").alias("other"), F.min("ord").alias("ord"))
    own = stage(own, "deep-edges")
    if own.where("up <> other").limit(1).count():
        raise ValueError("a child has two parents: the edges are no tree")
    rank = stage(global_ordinal(own.select("child", "ord"), [F.col("ord"), F.col("child")], "rank"), "deep-ranks")
    todo = own.join(rank.select(F.col("child").alias("c"), "rank"), F.col("child") == F.col("c")).select(F.col("child").alias("node"), "up", F.lit(1).alias("depth"), "rank")
    todo = stage(todo, "deep-nodes")
    at_root = F.col("up") == F.lit(root)
    every, reach, n = todo, 1, todo.count()
    while reach <= n:
        todo = every.where(~at_root)
        if not todo.limit(1).count():
            break
        far = every.select(F.col("node").alias("f"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("rank").alias("rank2"))
        moved = stage(todo.join(far, F.col("up") == F.col("f")).select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), "rank2", "rank"), "deep-moved")
        pairs = stage(global_ordinal(moved.select("rank2", "rank").distinct(), [F.col("rank2"), F.col("rank")], "new"), "deep-ranks")
        moved = moved.join(pairs, ["rank2", "rank"]).select("node", "up", "depth", F.col("new").alias("rank"))
        every = stage(every.where(at_root).union(moved), "deep-nodes")
        reach *= 2
    first = spark.createDataFrame([(root,)], "node string").select(F.col("node").cast(kind).alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank"))
    return global_ordinal(first.union(every.where(at_root).select("node", "depth", "rank")), [F.col("depth"), F.col("rank")]).select("node", "depth", "idx")
