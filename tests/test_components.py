import random

from conftest import rows

from plateworks.operators.components import connected_components, star_edges


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


def test_random_graphs_and_chains(spark):
    r = random.Random(3)
    for edges in (
        [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)],
        [(i, i + 1) for i in range(70)] + [(None, 3), (5, None), (9, 9)],
        [(0, i) for i in range(1, 60)],
    ):
        got = connected_components(spark.createDataFrame(edges, "u long, v long"))
        assert {tuple(x) for x in rows(got)} == union_find(edges)


def test_empty_and_strings(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
    got = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string"))
    assert rows(got) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_stars_leave_out_nulls_and_single_nodes(spark):
    m = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (None, "y"), (5, None), (2, "x")], "node int, key string")
    assert {tuple(r) for r in star_edges(m, "node", "key").collect()} == {(2, 1), (3, 1)}
