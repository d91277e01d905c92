"""Levels of a graph and of groups, fits from moments."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import graph, levels


def test_dag_levels_join_each_edge_once(spark):
    rng = random.Random(6)
    edges = [(a, b) for a, b in (sorted(rng.sample(range(200), 2)) for _ in range(500))] + [(5, 190), (5, 190), (300, 301), (301, 300), (301, 302), (None, 4), (4, None)]
    nodes = [(k,) for k in range(200)] + [(300,), (301,), (302,), (400,)]
    got = {r.node_id: r for r in graph.dag_levels(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(nodes, "node_id long")).collect()}
    want = dict.fromkeys([*range(200), 400], 0)
    for a, b in sorted(e for e in edges if None not in e and e[0] < 300):
        want[b] = max(want[b], want[a] + 1)
    assert {k: r.level for k, r in got.items()} == want
    assert sum(r.arrived for r in got.values()) == sum(1 for a, b in edges if None not in (a, b) and a < 300)


@pytest.mark.parametrize("few", [levels.FEW, 0])
def test_weighted_levels_equal_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(levels, "FEW", few)
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([rng.uniform(-1, 1), rng.uniform(0, 1e-9), 1e300, -1e300, 3.0, 2.0]), rng.randint(0, 9)) for _ in range(3000)]
    rows += [("one", 5.0, 1), ("none", 5.0, 0), ("nulls", None, 4), ("nan", math.nan, 4), ("tie", 1.0, 1), ("tie", 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long").repartition(5)
    for share in (0.1, 0.5, 1.0):
        got = {r.g: (r.level, r.weight) for r in levels.weighted_levels(df, ["g"], "v", F.col("w"), share).collect()}
        want = {}
        for g in {r[0] for r in rows}:
            own = sorted((v, w) for h, v, w in rows if h == g and v is not None and not math.isnan(v))
            whole, upto = sum(w for _, w in own), 0
            for v, w in own if whole else ():
                upto += w
                if upto >= whole * share:
                    want[g] = (v, whole)
                    break
        # equal values count together: the level is the same
        assert got == want
    assert levels.weighted_levels(df.limit(0), ["g"], "v", F.col("w"), 0.5).count() == 0


def test_circles_through_points(spark):
    points = [(1, 3 + 2 * math.cos(t), -4 + 2 * math.sin(t)) for t in (0, 1, 2.5, 4)] + [(2, float(k), 2.0 * k) for k in range(5)] + [(3, 1.0, 1.0), (1, None, 2.0)]
    got = {r.g: r for r in levels.fitted_circles(spark.createDataFrame(points, "g int, x double, y double"), ["g"], "x", "y").collect()}
    assert (got[1].n, got[1].cx, got[1].cy, got[1].radius) == (4, pytest.approx(3), pytest.approx(-4), pytest.approx(2))
    assert got[2].cx is None and got[2].radius is None and got[3].radius is None
