"""Components of graphs, against plain union."""

import random

import numpy as np

from martwright.llm.common import components, forest


def plain(edges):
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in root}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(6000, 6200)]
    found = components(spark.createDataFrame(edges, "x long, y long"))
    want = {i: r for i, r in plain(e for e in edges if e[0] != e[1]).items() if i != r}
    assert {r["vertex"]: r["root"] for r in found.collect()} == want
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_forest():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 200, (2, 150))
    root = forest(200, [(pairs[0, i::3], pairs[1, i::3]) for i in range(3)])
    want = plain([(i, i) for i in range(200)] + list(zip(*pairs.tolist())))
    assert root.tolist() == [want[i] for i in range(200)]
