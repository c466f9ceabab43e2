import random

from tessera.operators.components import components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
