"""Components against union-find, and graphs that are stars from the start."""

import random

from tesserae.llm.common import Cuts
from tesserae.llm.components import connected_components


def found(spark, edges):
    return sorted(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Cuts(spark, "test-components")).collect())


def expected(edges):
    root = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = root.setdefault(a, a), root.setdefault(b, b)
        root.update({n: min(a, b) for n, r in root.items() if r in (a, b)})
    return sorted(root.items())


def test_stars_need_no_rounds(spark):
    edges = [(1, k) for k in range(2, 9)] + [(20, 21), (21, 20)]
    assert found(spark, edges) == expected(edges)


def test_chains_cycles_and_odd_edges(spark):
    r = random.Random(3)
    names = r.sample(range(1000), 80)
    edges = [(names[k], names[k + 1]) for k in range(24)] + [(names[30 + k], names[30 + (k + 1) % 9]) for k in range(9)]
    edges += [(r.choice(names[45:]), r.choice(names[45:])) for _ in range(25)] + [(5, 5), (None, 3), (4, None)]
    assert found(spark, edges) == expected(edges)


def test_no_edges(spark):
    assert found(spark, []) == []
