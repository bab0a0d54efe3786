"""Merkle manifest of a table: a tree for each group of rows, and a tree over the groups' roots.

Leaves are digests of rows, in the order of doc_id within their group; every ``ARITY`` consecutive nodes of a level, the
last run fewer, become one of the next, until one is left. Which nodes form a run follows from a tree's number of leaves
alone, so a part of the leaves is a *fragment*: nodes known by (tree, level, index), of which every whole run has
been replaced by its parent. Fragments form a monoid: merging is union, then the same replacement, and as a run is
whole or not regardless of the order in which its nodes came, merging is associative and commutative.

* Rows are ranged by (group, doc_id) into parts of about ``LEAVES`` rows; each part folds its own fragment. A group that
  ends in a part becomes a leaf of the tree over groups, so what a part leaves unresolved is a few nodes a level on its
  two edges, however many groups it holds.
* ``_tree_reduce`` merges ``FAN`` neighbouring fragments at a time, in rounds that are staged tables, until one node, the
  root, is left. It alone comes to the driver. Nodes that rounds make are kept: they are what parts lack.
* A part that knows the nodes beside its edges, a few a level, can fold all of its own rows up to the root, so proofs and
  checks of claimed leaves need one more pass, with one join of small rows.

The tree over groups has number ``TOP``, a group its rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinal import global_ordinal
from ..session import ship, stage

ARITY, TOP = 3, -1
LEAVES, FAN = 1 << 16, 32
NODES = "part long, tree long, level int, idx long, n long, digest binary"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple[int, int, int]  # tree, level, index
Fragment = dict[Node, bytes]


def encoded(fields: tuple[str, ...] | list[Column]) -> Column:
    """The row as text: each field ``-`` if null, else its number of UTF-8 bytes, ``:`` and itself."""
    out = []
    for f in fields:
        s = (F.col(f) if isinstance(f, str) else f).cast("string")
        out.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.concat(*out)


def leaf(fields: tuple[str, ...] | list[Column] = FIELDS) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(encoded(fields), 256))


def combined(run: list[bytes]) -> bytes:
    """The parent of a run: SHA-256 of its digests as hex text."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree of n leaves."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    """The level of the root."""
    h = 0
    while width(n, h) > 1:
        h += 1
    return h


def settled(nodes: Fragment, sizes: dict[int, int], made: Fragment) -> Fragment:
    """The fragment of these nodes: every whole run is replaced by its parent, which ``made`` gets too. A group's root
    is a leaf of the tree over groups. sizes: the number of leaves by tree."""
    nodes = dict(nodes)
    todo = sorted(nodes, key=lambda k: (k[0] == TOP, k[1], k[2]))
    while todo:
        fresh = []
        for tree, level, idx in todo:
            if (tree, level, idx) not in nodes:
                continue
            wide = width(sizes[tree], level)
            if wide == 1:
                if tree == TOP:
                    continue
                up, run = (TOP, 0, tree), [(tree, level, idx)]
                digest = nodes[run[0]]
            else:
                first = idx - idx % ARITY
                run = [(tree, level, i) for i in range(first, min(first + ARITY, wide))]
                if not all(k in nodes for k in run):
                    continue
                up, digest = (tree, level + 1, idx // ARITY), combined([nodes[k] for k in run])
            for k in run:
                del nodes[k]
            nodes[up] = made[up] = digest
            fresh.append(up)
        todo = fresh
    return nodes


def edges(lo: int, hi: int, n: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that, with the leaves lo to hi of n, settle all their paths to the root."""
    for level in range(height(n)):
        last = min(width(n, level), hi - hi % ARITY + ARITY)
        for i in (*range(lo - lo % ARITY, lo), *range(hi + 1, last)):
            yield level, i
        lo, hi = lo // ARITY, hi // ARITY


class Paths:
    """The nodes over the leaves lo to lo + len(leaves) - 1 of a tree of n, with what ``edges`` names given."""

    def __init__(self, leaves: list[bytes], lo: int, n: int, given: dict[tuple[int, int], bytes]):
        self.levels: list[tuple[int, list[str]]] = []  # first index, digests as hex text, whole runs
        row = [x.hex() for x in leaves]
        for level in range(height(n)):
            first, wide = lo - lo % ARITY, width(n, level)
            end = min(wide, (lo + len(row) - 1) // ARITY * ARITY + ARITY)
            row = [given[level, i].hex() for i in range(first, lo)] + row + [given[level, i].hex() for i in range(lo + len(row), end)]
            self.levels.append((first, row))
            row = [hashlib.sha256("".join(row[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(row), ARITY)]
            lo = first // ARITY
        self.root = row[0]

    def beside(self, i: int) -> list[tuple[str, str]]:
        """What stands left and right of leaf i in its run, and so on up to the root."""
        out = []
        for first, row in self.levels:
            at = i - i % ARITY - first
            out.append(("".join(row[at : i - first]), "".join(row[i - first + 1 : at + ARITY])))
            i //= ARITY
        return out


def _nodes(part: int, nodes: Fragment, sizes: dict[int, int], **flags: list[bool]) -> pa.Table:
    tree, level, idx = zip(*nodes, strict=True) if nodes else ((), (), ())
    cols = {
        "part": pa.array([part] * len(nodes), pa.int64()),
        "tree": pa.array(tree, pa.int64()),
        "level": pa.array(level, pa.int32()),
        "idx": pa.array(idx, pa.int64()),
        "n": pa.array([sizes[k] for k in tree], pa.int64()),
        "digest": pa.array(list(nodes.values()), pa.binary()),
    }
    return pa.table(cols | {k: pa.array(v, pa.bool_()) for k, v in flags.items()})


def _by_tree(rows: pa.Table) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """Rows in the order of (tree, index) -> tree, number of its leaves, index of the first one here, leaves here."""
    tree = rows["tree"].to_numpy()
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(tree)], strict=True):
        yield int(tree[s]), rows["n"][s].as_py(), rows["idx"][s].as_py(), rows["leaf"].slice(s, e - s).to_pylist()


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("tree", "ascending"), ("idx", "ascending")])


def _own_fragment(groups: int):
    """The rows of a part -> what is unresolved in it. groups: how many there are in the table."""

    def own(rows: pa.Table) -> pa.Table:
        left: Fragment = {}
        sizes = {TOP: groups}
        for tree, n, lo, row in _by_tree(_ordered(rows)):
            sizes[tree], level = n, 0
            while row and width(n, level) > 1:  # whole runs go up; what stands before and after them is left here
                end = lo + len(row)
                a = min(end, lo + -lo % ARITY)
                z = end if end == width(n, level) else max(a, end - end % ARITY)
                left |= {(tree, level, i): row[i - lo] for i in chain(range(lo, a), range(z, end))}
                row = [combined(row[i - lo : min(i + ARITY, z) - lo]) for i in range(a, z, ARITY)]
                lo, level = a // ARITY, level + 1
            if row:
                left[TOP, 0, tree] = row[0]
        return _nodes(rows["part"][0].as_py(), settled(left, sizes, {}), sizes)

    return own


def _merged(groups: int):
    """The fragments of a block -> its own, with what was made on the way: fresh, and open if unresolved."""

    def merged(rows: pa.Table) -> pa.Table:
        nodes: Fragment = {}
        sizes, made = {TOP: groups}, {}
        for r in rows.to_pylist():
            nodes[r["tree"], r["level"], r["idx"]] = r["digest"]
            sizes[r["tree"]] = r["n"]
        rest = settled(nodes, sizes, made)
        out = rest | made
        return _nodes(rows["part"][0].as_py(), out, sizes, fresh=[k in made for k in out], open=[k in rest for k in out])

    return merged


def _tree_reduce(own: DataFrame, parts: int, groups: int) -> tuple[str, DataFrame]:
    """Fragments of parts -> the root as hex text, and every node that stood in a fragment."""
    nodes, current = [own], own
    while True:
        parts = -(-parts // FAN)
        block = current.withColumn("part", F.floor(F.col("part") / FAN))
        merged = stage(block.groupBy("part").applyInArrow(_merged(groups), f"{NODES}, fresh boolean, open boolean"), "merkle-round")
        nodes.append(merged.where("fresh").drop("fresh", "open"))
        current = merged.where("open").drop("fresh", "open")
        if parts == 1:
            break
    (root,) = current.collect()  # one row
    return root["digest"].hex(), reduce(DataFrame.union, nodes).select("tree", "level", "idx", "digest")


def _lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (part, tree, n, lo, hi) -> the nodes that their part lacks."""
    for b in batches:
        out = [(r["part"], r["tree"], level, i) for r in b.to_pylist() for level, i in edges(r["lo"], r["hi"], r["n"])]
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "tree", "level", "idx"])


def _prover(root: str, groups: int):
    """The rows of a part and the nodes that it lacks -> the rows with their proofs."""

    def proofs(rows: pa.Table, given: pa.Table) -> Iterator[tuple[str, str, str, str, str, bool]]:
        known: dict[int, dict[tuple[int, int], bytes]] = {}
        for r in given.to_pylist():
            known.setdefault(r["tree"], {})[r["level"], r["idx"]] = r["digest"]
        trees = [(tree, lo, len(row), Paths(row, lo, n, known.get(tree, {}))) for tree, n, lo, row in _by_tree(rows)]
        over = Paths([bytes.fromhex(p.root) for *_, p in trees], trees[0][0], groups, known.get(TOP, {}))
        every = zip(rows["leaf"].to_pylist(), rows["claimed"].to_pylist(), strict=True)
        for tree, lo, count, paths in trees:
            above = over.beside(tree)
            for i in range(lo, lo + count):
                leaf_, claim = next(every)
                path = [*paths.beside(i), *above]
                now = (leaf_ if claim is None else claim).hex()
                for before, after in path:
                    now = hashlib.sha256((before + now + after).encode()).hexdigest()
                proof = hashlib.sha256("".join(chain.from_iterable(path)).encode()).hexdigest()
                yield leaf_.hex(), paths.root, over.root, proof, now, now == root

    def prove(rows: pa.Table, given: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        cols = list(zip(*proofs(rows, given), strict=True))
        kinds = [pa.string()] * 5 + [pa.bool_()]
        out = {"doc_id": rows["doc_id"], "source": rows["source"]}
        return pa.table(out | {k: pa.array(c, t) for k, c, t in zip(PROVEN, cols, kinds, strict=True)})

    return prove


PROVEN = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _placed(docs: DataFrame, doc_id: str, group: str, fields: tuple[str, ...], claimed: Column | None) -> tuple[DataFrame, int, int]:
    """A staged row for each of docs: its part, its tree and index, the digests; the numbers of parts and groups."""
    spark = docs.sparkSession
    other = F.lit(None).cast("binary") if claimed is None else claimed
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(group).alias("source"), leaf(fields).alias("leaf"), other.alias("claimed"), F.monotonically_increasing_id().alias("tag"))
    rows = stage(rows, "merkle-leaves", of=docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LEAVES))
    order = ["source", "doc_id", "leaf", "tag"]  # the tag parts rows that repeat, which are interchangeable
    rows = stage(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id().cast("long")), "merkle-ranged", of=docs)
    whole = Window.partitionBy("source")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("part", "source").agg(F.count("*").alias("c")).select("part", "source", before.alias("before"), F.sum("c").over(whole).alias("n"))
    counts = stage(counts, "merkle-counts")
    ranks = stage(global_ordinal(counts.select("source").distinct(), [F.col("source")], "rank"), "merkle-groups")  # null first, else bytewise
    counts = counts.join(ranks.select(F.col("source").alias("of"), "rank"), F.col("source").eqNullSafe(F.col("of")))
    counts = counts.select(F.col("part").alias("p"), F.col("source").alias("s"), "before", "n", (F.col("rank") - 1).alias("tree"))
    nth = F.row_number().over(Window.partitionBy("part", "source").orderBy("doc_id", "leaf", "tag"))
    placed = rows.withColumn("nth", nth).join(counts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    placed = stage(placed.select("part", "tree", "n", (F.col("before") + F.col("nth") - 1).alias("idx"), "doc_id", "source", "leaf", "claimed"), "merkle-placed", of=docs)
    return placed, (rows.agg(F.max("part")).first()[0] or 0) + 1, ranks.count()


def attest(docs: DataFrame, claimed: Column | None = None, doc_id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    claimed: the digest that someone else claims for a row, null for the one it has; ``folded_root`` is the root that
    follows from it and the row's siblings, ``verified`` says whether that is the table's. proof_sha256: the digest of
    the siblings' hex text up to the root, from left to right in each run. Rows of null group form the first tree, a
    null doc_id comes first in its tree, rows that repeat get a leaf each, in an order that doesn't matter as they are
    alike. An empty table gives no rows; columns that ``fields`` doesn't name have no part in the digests.
    """
    spark = docs.sparkSession
    ship(spark)
    placed, parts, groups = _placed(docs, doc_id, group, fields, claimed)
    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select("doc_id", "source").schema)
    schema = f"{ids}, {', '.join(f'{c} string' for c in PROVEN[:-1])}, verified boolean"
    if not groups:
        return spark.createDataFrame([], schema)
    own = placed.select("part", "tree", "n", "idx", "leaf").groupBy("part").applyInArrow(_own_fragment(groups), NODES)
    root, nodes = _tree_reduce(stage(own, "merkle-own"), parts, groups)
    spans = placed.groupBy("part", "tree", "n").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).where("lo > 0 or hi < n - 1")
    tops = placed.groupBy("part").agg(F.lit(TOP).cast("long").alias("tree"), F.lit(groups).cast("long").alias("n"), F.min("tree").alias("lo"), F.max("tree").alias("hi"))
    lacking = stage(spans.union(tops).mapInArrow(_lacking, "part long, tree long, level int, idx long"), "merkle-lacking")
    given = lacking.join(nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest")
    return placed.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(_prover(root, groups), schema)


def manifest(docs: DataFrame, **how) -> DataFrame:
    """(source, n, subroot, root): the groups' digests and the table's. Groups whose subroot differs between two
    manifests are those that changed."""
    return attest(docs, **how).groupBy("source", "subroot", "root").agg(F.count("*").alias("n")).select("source", "n", "subroot", "root")
