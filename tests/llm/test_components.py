import random

import pytest

from vecscore.llm.components import components


def roots(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(2, 1), (1, 2), (2, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(7, 7), (8, 9)],
    [tuple(random.Random(k).sample(range(90), 2)) for k in range(60)],
])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.comp for r in got.collect()} == roots(edges)
