"""Connected components of a link table, distributed: hook to the smallest neighbour, jump, contract.

Each round at least halves the nodes that still have links, so rounds grow with the logarithm of the
longest chain. Minima are pre-aggregated before the shuffle, and relabelling joins a skewed side with a
side that has one row a key, which adaptive execution can split; no star, however large, meets in one
task. Every round is cut off as a table in the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stage
from .common import arrow_map, union_min


def _thin(batches):
    """Replace the links of each batch by a spanning forest of them."""
    import numpy as np

    for b in batches:
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        lab = union_min(len(nodes), at[: len(x)], at[len(x) :])
        i = np.flatnonzero(lab != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lab[i]]), pa.array(nodes[i])], ["a", "b"])


def connected_components(links: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """links(a long, b long) -> (node, component): the smallest node reachable, for every node in a link.

    of: a stored table that the links are made of and that sets the number of files. Null ends are ignored, loops give no row, repeated links count once, an empty table gives an empty one.
    """
    spark = links.sparkSession
    ship(spark)
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = stage(edges, "links", of=of)  # so that no task runs two Python workers
    edges = stage(edges.transform(arrow_map, _thin, "a long, b long").distinct(), "links", edges.count())
    out: DataFrame | None = None
    nodes = 0  # as many as out has at most
    while n := edges.count():
        both = edges.union(edges.select("b", "a"))
        up = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("top")).where("top < node"), "hooks", n)
        while True:  # jump until every node points to a root
            over = up.select(F.col("node").alias("n2"), F.col("top").alias("t2"))
            jumped = up.join(over, F.col("top") == F.col("n2"), "left").select("node", F.coalesce("t2", "top").alias("top"), F.col("t2").isNotNull().alias("moved"))
            jumped = stage(jumped, "jumps", n)
            up = jumped.select("node", "top")
            if not jumped.where("moved").limit(1).count():
                break
        nodes += n
        if out is None:
            out = up
        else:
            lift = up.select(F.col("node").alias("n2"), F.col("top").alias("t2"))
            out = out.join(lift, F.col("top") == F.col("n2"), "left").select("node", F.coalesce("t2", "top").alias("top")).union(up)
            out = stage(out, "tops", nodes)
        for end in ("a", "b"):
            lift = up.select(F.col("node").alias("n2"), F.col("top").alias("t2"))
            other = "b" if end == "a" else "a"
            edges = edges.join(lift, F.col(end) == F.col("n2"), "left").select(F.coalesce("t2", end).alias(end), other)
        edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", n)
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.select("node", F.col("top").alias("component")).union(out.select(F.col("top").alias("node"), F.col("top").alias("component")).distinct())
