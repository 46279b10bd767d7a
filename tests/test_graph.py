import random

import pytest

from quarry.graph import connected_components


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops"])
def test_components(spark, kind):
    rnd = random.Random(4)
    n = 200
    edges = {
        "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(150)],
        "path": [(i, i + 1) for i in rnd.sample(range(60), 60)],
        "star": [(i, 100) for i in range(99)],
        "loops": [(5, 5), (6, 5), (6, 5), (9, 9)],
    }[kind]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == union_find(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
