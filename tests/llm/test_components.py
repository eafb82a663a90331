import random

import pytest

from lineward.llm.components import components


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    links += [(i, i + 1) for i in range(200, 240)]  # a long chain
    links += [(300, i) for i in range(301, 400)]  # a node with many links
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: top(x) for x in parent if top(x) != x}


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
