"""Loops go on until nothing changes, however long the way is."""

import pytest

from tarnflow.operators import film, fsm, graph

FAR = 67


def test_a_basin_far_from_the_sink_drains(spark):
    # Pits and rising ridges in a row, the sink at the low end: pits hold water, no ridge is under it.
    n = 2 * FAR
    nodes = spark.createDataFrame([(k, k if k % 2 else -k, k == 0) for k in range(n)], "node_id long, h long, sink boolean")
    links = spark.createDataFrame([(a, b) for k in range(n - 1) for a, b in ((k, k + 1), (k + 1, k))], "src long, dst long")
    held = {r.node_id: r.held for r in fsm.flooded(nodes, links).collect()}
    assert held == {k: k > 0 and k % 2 == 0 for k in range(n)}


def test_levels_feed_through_many_throats(spark):
    full = spark.createDataFrame([(k,) for k in range(1, FAR + 1)], "lab long")
    throats = spark.createDataFrame([(k, k + 1, 5.0 if k == 0 else None, None, 1.0) for k in range(FAR)], "a long, b long, level_a double, level_b double, top double")
    assert sorted(map(tuple, graph.fed_levels(full, throats).collect())) == [(k, 5.0) for k in range(1, FAR + 1)]


def test_film_in_a_circle_is_an_error(spark):
    weights = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    with pytest.raises(ValueError, match="circle"):
        film.levels(weights)
