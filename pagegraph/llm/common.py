"""Shared pieces: word rules, record batches, groups of sorted rows, a min-label union."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` breaks at just these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a row where doc_id may repeat or be null: rows that share it are copies."""
    return F.xxhash64(doc_id, text, F.lit(7))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column: columns of the caller are never overwritten."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_prefix(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has, for the names of columns put beside the caller's."""
    p = "pg_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def fold(doc_id: Column, n: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows by key into as many partitions as the session's shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def release() -> None:
    """Give freed memory of this worker back to the system: it will serve other operators too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow whose workers give their memory back at the end of a task."""

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(g, schema)


def grouped(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """From rows sorted by a long key: blocks (starts of groups, columns) in which no group is cut.

    Only the last, open group of a batch is carried over, so memory is a batch and the largest group.
    """
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))  # sorted: the first row of the last group
        if cut == 0 and (not rest or rest[-1].column(key)[0].as_py() == k[0]):
            rest.append(b)
            continue
        if rest and (cut == 0 or rest[-1].column(key)[0].as_py() != k[0]):
            yield _block(rest, key)
            rest = []
        if cut:
            yield _block([*rest, b.slice(0, cut)], key)
        rest = [b.slice(cut)]
    if rest:
        yield _block(rest, key)


def _block(parts: list[pa.RecordBatch], key: int) -> tuple[np.ndarray, list[pa.Array]]:
    t = pa.Table.from_batches(parts).combine_chunks()
    cols = [c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in t.columns]
    k = cols[key].to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), cols


def bounded_groups(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Rows (key, value) of longs, sorted by key -> (large, keys, values).

    Not large: whole groups, repeats included, of the size of a batch at most. Large: a piece of a group of more than
    ``block`` distinct values, of which no more than that and a batch is ever held; the pieces may repeat values.
    """
    held, of, large = np.zeros(0, np.int64), None, False
    for b in batches:
        if not b.num_rows:
            continue
        k, x = b.column(0).to_numpy(), b.column(1).to_numpy()
        first = int(np.searchsorted(k, of, side="right")) if of is not None else 0  # rows of the group that is open
        if first:
            more = x[:first]
            if not large:
                held = more = np.unique(np.r_[held, more])
                large = len(held) > block
            if large:
                yield True, np.full(len(more), of, np.int64), more
        if first == len(k):
            continue
        if of is not None and not large:
            yield False, np.full(len(held), of, np.int64), held
        last = max(first, int(np.searchsorted(k, k[-1])))  # the last group may go on
        if last > first:
            yield False, k[first:last], x[first:last]
        of, held = k[-1], np.unique(x[last:])
        large = len(held) > block
        if large:
            yield True, np.full(len(held), of, np.int64), held
    if of is not None and not large:
        yield False, np.full(len(held), of, np.int64), held


def union_min(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links a-b, by hooking and jumping."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        on = la != lb
        if not on.any():
            break
        a, b, la, lb = a[on], b[on], la[on], lb[on]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab
