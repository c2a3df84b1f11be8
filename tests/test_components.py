import random

from quern.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_components_in_several_levels(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1200)] + [(i, i + 1) for i in range(5000, 5400)] + [(9000, 9000), (1, 2), (1, 2)] + [(0, 10_000 + i) for i in range(500)]
    df = spark.createDataFrame(edges + [(None, 1), (1, None)], "u long, v long").repartition(8)
    for last in (100_000, 50, 1):
        assert {r.node: r.component for r in connected_components(df, last=last).collect()} == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
