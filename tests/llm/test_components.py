import random

import pytest

from pagegraph.llm.components import connected_components

from .conftest import data


def plain(links):
    top = {}
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for x in sorted(near):
        if x not in top:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in top:
                    top[y] = x
                    todo += near[y]
    return sorted(top.items())


r = random.Random(2)
nodes = r.sample(range(-(10**6), 10**6), 1000)
CASES = {
    "chain": list(zip(nodes, nodes[1:], strict=False)),
    "sorted chain": [(i, i + 1) for i in range(1000)],
    "star": [(5, i) for i in range(-1000, 1000)],
    "ring and tree": [(i, (i + 1) % 50) for i in range(50)] + [(100 + i, 100 + i // 2) for i in range(1, 200)],
    "loops, repeats, nulls": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (None, None), (6, 7), (7, 8)],
    "random": [(r.randrange(400), r.randrange(400)) for _ in range(300)],
    "empty": [],
    "only loops": [(1, 1), (2, 2)],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    links = spark.createDataFrame(CASES[case], "a long, b long").repartition(5)
    assert sorted(data(connected_components(links))) == plain(CASES[case])
