"""Clusters of vectors around centroids, in whole numbers: every distance, sum and mean is exact.

A vector's nearest centroid lies in an annulus: with u the distance to any one centroid, a centroid c that is no farther
has | |c| - |x| | <= u, as | |c| - |x| | <= |c - x|. So centroids are sorted by norm, u is the distance to those next
to |x| in that order and to some spread over all of it, the ends of the annulus are found by bisection, and only the centroids between them are compared
exactly, as squared distances of whole numbers. Norms are floating point, so the annulus is made wider than the rounding
by ``SLACK``: centroids on its boundary, as far as the nearest one, are compared too, and the smaller number wins.

What goes around the cluster is a parameter's size: the centroids, told to all tasks, and a row of sums for each
of them from each task, added up in partial aggregations.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, stage
from .common import arrow_map

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components are at most this large, so that squared distances of up to 2 ** 8 components are exact in 64 bits.
LARGEST = 1 << 26
SLACK = 1e-9
PAIRS = 1 << 15  # (vector, centroid) compared at a time


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors with exactly ``dimensions`` components, none null or non-finite: each
    component x becomes floor(scale * x)."""
    x = F.col(embedding)
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    kept = vectors.where(x.isNotNull() & (F.size(x) == dimensions) & F.forall(x, good))
    v = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-2.0 * LARGEST)), F.lit(2.0 * LARGEST))))
    far = F.exists(v, lambda c: F.abs(c) > LARGEST)
    v = F.when(far, F.raise_error(F.lit(f"components beyond {LARGEST} have no exact distances"))).otherwise(v)
    return kept.select(F.col(vec_id).alias("vec_id"), v.cast("array<bigint>").alias("v"))


@dataclass(frozen=True)
class Annuli:
    """Centroids (k, dimensions) sorted by norm."""

    points: np.ndarray
    numbers: np.ndarray
    squares: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Annuli:
        squares = (centroids * centroids).sum(axis=1)
        order = np.argsort(squares, kind="stable")
        return cls(centroids[order], order, squares[order], np.sqrt(squares[order].astype(np.float64)))

    def bounds(self, x: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, first and past the last, of the centroids in each vector's annulus."""
        norm, k, i = np.sqrt(square.astype(np.float64)), len(self.norms), np.arange(len(x))
        at = np.searchsorted(self.norms, norm)
        probes = np.linspace(0, k - 1, math.isqrt(k)).astype(np.int64)
        square_u = np.minimum(self.distances(x, square, i, np.maximum(at - 1, 0)), self.distances(x, square, i, np.minimum(at, k - 1)))
        for p in probes.tolist():
            square_u = np.minimum(square_u, self.distances(x, square, i, np.full(len(x), p)))
        u = np.sqrt(square_u.astype(np.float64))
        wide = u + SLACK * (u + norm + 1)
        return np.searchsorted(self.norms, norm - wide), np.searchsorted(self.norms, norm + wide, side="right")

    def distances(self, x: np.ndarray, square: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances of vectors i to the centroids at positions j."""
        return square[i] + self.squares[j] - 2 * np.einsum("nd,nd->n", x[i], self.points[j])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid, the smaller one of equals, and the squared distance."""
        square = np.einsum("nd,nd->n", x, x)
        lo, hi = self.bounds(x, square)
        cluster, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        ends = np.cumsum(hi - lo)
        s = 0
        while s < len(x):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, side="right")))
            count = (hi - lo)[s:e]
            starts = np.r_[0, np.cumsum(count)[:-1]]
            i = np.repeat(np.arange(s, e), count)
            j = np.arange(len(i)) - np.repeat(starts - lo[s:e], count)
            d = self.distances(x, square, i, j)
            least = np.minimum.reduceat(d, starts)
            number = np.where(d == np.repeat(least, count), self.numbers[j], len(self.numbers))
            cluster[s:e], distance[s:e] = np.minimum.reduceat(number, starts), least
            s = e
        return cluster, distance


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _summing(annuli: Annuli, k: int, dimensions: int):
    """Vectors -> a row (cluster, n, sums) for each cluster that has some in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for b in batches:
            x = _matrix(b.column(0), dimensions)
            cluster, _ = annuli.nearest(x)
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _naming(annuli: Annuli, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = annuli.nearest(_matrix(b.column(1), dimensions))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, name: Column) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``name``, in that order; vectors of one name by their components."""
    rows = vectors.select("v", F.sha2(name, 256).alias("h")).orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid with vectors becomes floor(sum / count) of them."""
    k, dimensions = centroids.shape
    parts = vectors.select("v").transform(arrow_map, _summing(Annuli.of(centroids), k, dimensions), "cluster long, n long, sums array<bigint>")
    sums = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dimensions)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dimensions)]
    return out


def clusters(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    Vectors with other than ``dimensions`` components, or with a null or non-finite one, give no row; components whose
    whole number exceeds ``LARGEST`` end the query with an error. The first centroids are the k vectors with the least
    SHA-256 of ``1:<vec_id>`` (a null id: ``1:``); there are fewer where there are fewer vectors, and no vectors give no
    rows. Rows that repeat count each. Centroids that are equal stay apart, the smaller number gets the vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    points = stage(whole_numbers(vectors, vec_id, embedding, dimensions, scale), "centroid-vectors", of=vectors)
    name = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    centroids = first_centroids(points, k, name).reshape(-1, dimensions)
    kind = points.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(points, centroids)
    named = stage(points.transform(arrow_map, _naming(Annuli.of(centroids), dimensions), f"vec_id {kind}, cluster int, distance long"), "centroid-named", of=vectors)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(digests, "c int, centroid_sha256 string")
    each = named.groupBy(F.col("cluster").alias("c")).agg(F.sum("distance").alias("cluster_inertia"))
    each = each.join(digests, "c").crossJoin(F.broadcast(named.agg(F.sum("distance").alias("inertia"))))  # one row
    return named.join(F.broadcast(each), F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
