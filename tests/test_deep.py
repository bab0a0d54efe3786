from random import Random

import pytest

from pagegraph.operators import deep

EDGES = "parent string, ord long, child string"


def plain(edges, root):
    kids = {}
    for p, o, c in sorted(set(edges), key=lambda e: (e[0], e[1], e[2])):
        if c != root:
            kids.setdefault(p, []).append(c)
    out, queue = [], [(root, 0)]
    while queue:
        n, d = queue.pop(0)
        out.append((n, d, len(out) + 1))
        queue += [(c, d + 1) for c in kids.get(n, [])]
    return out


def order(spark, edges, root="r"):
    return sorted((tuple(x) for x in deep.tree_order(spark.createDataFrame(edges, EDGES), root).collect()), key=lambda x: x[2])


def test_random_trees(spark):
    r = Random(1)
    names = [f"n{k}" for k in range(400)]
    r.shuffle(names)
    edges = []
    for k, n in enumerate(names):
        up = "r" if k == 0 else r.choice(["r", *names[max(0, k - 3) : k]])
        edges.append((up, r.randrange(4), n))
    edges += [("n3", 0, "r"), ("ring1", 0, "ring2"), ("ring2", 1, "ring1"), ("ring1", 5, "hangs"), ("nowhere", 1, "lost"), (None, 0, "x"), edges[7]]
    assert order(spark, edges) == plain([e for e in edges if e[0]], "r")


def test_a_chain_of_5000_takes_few_rounds(spark, monkeypatch):
    rounds, ranks = [], deep.global_ordinal
    monkeypatch.setattr(deep, "global_ordinal", lambda *a: rounds.append(1) or ranks(*a))
    edges = [("r" if k == 0 else f"c{k - 1}", 1, f"c{k}") for k in range(5000)]
    assert order(spark, edges) == [("r", 0, 1), *((f"c{k}", k + 1, k + 2) for k in range(5000))]
    assert len(rounds) < 20


def test_no_tree_and_nothing(spark):
    with pytest.raises(ValueError, match="two parents"):
        order(spark, [("r", 0, "a"), ("r", 1, "b"), ("a", 0, "c"), ("b", 0, "c")])
    assert order(spark, []) == [("r", 0, 1)]
