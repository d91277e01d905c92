import random

import pytest

from tarnflow.operators import components
from tarnflow.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("most", [20_000, 0])
def test_components_of_chains_stars_and_random_edges(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_BROADCAST", most)
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    shuffled = rng.sample(range(100, 160), 60)
    path = list(zip(shuffled, shuffled[1:]))
    star = [(500, x) for x in range(501, 900)]
    noise = [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(150)]
    edges = [*chain, *path, *star, *noise, *noise[:20], (7, 7), (None, 3), (2000, 2000)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    names = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    assert {r.node: r.component for r in connected_components(names).collect()} == {"a": "a", "b": "a", "c": "a"}


def test_edges_of_hanging_nodes_take_no_part_in_rounds(spark, monkeypatch):
    edges = [(k, 1000 + 10 * k + d) for k in range(60) for d in range(9)] + [(k, k + 1) for k in range(0, 60, 2)] + [(5000, 5001), (-1, 7), (-2, -1)]
    joined, _with = [], components._with
    monkeypatch.setattr(components, "_with", lambda df, *more: joined.append((df.columns, df.count())) or _with(df, *more))
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    want = {n: (-2 if n in (6, 7, -1, -2) else n // 2 * 2) for n in (*range(60), -1, -2)} | {5000: 5000, 5001: 5000}
    want |= {1000 + 10 * k + d: want[k] for k in range(60) for d in range(9)}
    assert got == want
    assert max(n for columns, n in joined if "v" in columns) < 60
