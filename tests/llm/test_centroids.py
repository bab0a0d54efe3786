import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegraph.llm import centroids

from .conftest import data, same


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [[] for _ in cents]
        for _, v in kept:
            of[near(v)[1]].append(v)
        cents = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(of, cents, strict=True)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in got if c == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, inertia[c], sum(inertia), sha[c]) for i, c, d in got]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("seed,k,n,spread", [(1, 16, 300, 1.0), (2, 3, 50, 0.02), (3, 40, 25, 5.0), (4, 7, 200, 0.05)])
def test_equals_brute_force(spark, seed, k, n, spread, monkeypatch):
    monkeypatch.setattr(centroids, "PAIRS", 50)
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(rnd.choice((-1, 0, 1)), spread) for _ in range(6)]) for i in range(n)]
    rows += rows[:9] + [(None, rows[3][1]), (None, rows[4][1])]
    got = centroids.clusters(table(spark, rows), k=k, dimensions=6)
    assert same(data(got), brute(rows, k, 3, 6))


def test_rows_without_a_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, [inf, 0.0]), (9, [-0.001, 0.0]), (10, [1.0, 2.0, 3.0])]
    docs = table(spark, rows).withColumns({n: F.lit("x") for n in ("v", "h", "n", "sums", "cluster", "distance", "c")})
    got = centroids.clusters(docs, k=2, dimensions=2)
    assert same(data(got), brute(rows, 2, 3, 2))
    assert data(centroids.clusters(docs.where("false"), dimensions=2)) == data(centroids.clusters(docs.where("vec_id = 2"), dimensions=2)) == []


def test_large_components_are_an_error_not_a_wrong_distance(spark):
    with pytest.raises(Exception, match="no exact distances"):
        centroids.clusters(table(spark, [(1, [1e30, 0.0])]), dimensions=2).collect()
    rows = [(i, [(-1) ** i * (2.0**20 - i), i * 1.0]) for i in range(20)]
    assert same(data(centroids.clusters(table(spark, rows), k=4, dimensions=2)), brute(rows, 4, 3, 2))


def test_annulus_holds_the_nearest_and_leaves_others_out():
    rnd = np.random.default_rng(5)
    cents = rnd.integers(-50, 50, (60, 2)) * rnd.integers(1, 40, (60, 1))
    x = rnd.integers(-2000, 2000, (400, 2))
    ann = centroids.Annuli.of(cents)
    d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    lo, hi = ann.bounds(x, (x * x).sum(axis=1))
    for i in range(len(x)):
        inside = set(ann.numbers[lo[i] : hi[i]].tolist())
        assert set(np.flatnonzero(d[i] == d[i].min()).tolist()) <= inside
    assert (hi - lo).mean() < len(cents) / 2
    cluster, distance = ann.nearest(x)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_ties_on_the_boundary_go_to_the_smaller_number():
    cents = np.array([[0, 10], [10, 0], [0, -10], [-10, 0], [0, 10], [0, 20], [0, 0]], np.int64)
    x = np.array([[5, 5], [0, 0], [0, 15], [0, 5], [-5, -5], [0, 10]], np.int64)
    got = centroids.Annuli.of(cents).nearest(x)
    assert got[0].tolist() == [0, 6, 0, 0, 2, 0] and got[1].tolist() == [50, 0, 25, 25, 50, 0]
