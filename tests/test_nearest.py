"""The nearest neighbour at any distance equals a look at all pairs."""

import numpy as np
import pytest

from tarnflow.operators import nearest as N


def brute(points, others):
    out = {}
    for k, v in points:
        d = [(round(float(np.sqrt(np.square(np.array(v) - np.array(w)).sum())), 9), o) for o, w in others]
        out[k] = min(d)
    return out


@pytest.mark.parametrize(("dimensions", "pivots", "chunk"), [(3, 8, 16), (20, 64, 1024), (1, 1, 4)])
def test_equals_all_pairs(spark, monkeypatch, dimensions, pivots, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "VISITORS", 4 * chunk)
    rng = np.random.default_rng(dimensions)
    cloud = np.concatenate([rng.normal(size=(60, dimensions)) * 0.01 + 5, rng.normal(size=(60, dimensions)), rng.integers(0, 3, (60, dimensions))])
    others = [(k, v.tolist()) for k, v in enumerate(cloud)] + [(900 + k, cloud[k].tolist()) for k in range(5)]
    points = [(k, v.tolist()) for k, v in enumerate(np.concatenate([cloud[:20], rng.normal(size=(60, dimensions)) * 3, [[1e3] * dimensions]]))]
    bad = [(2000, None), (2001, [float("nan")] * dimensions), (2002, [0.0] * (dimensions + 1)), (2003, [None] * dimensions)]
    kind = "k long, v array<double>"
    got = N.nearest(spark.createDataFrame(points + bad, kind), "k", spark.createDataFrame(others + bad[:2], kind), "k", "v", pivots).collect()
    want = brute(points, others)
    assert len(got) == len(points) and all((round(r.distance, 9), r.other) == pytest.approx(want[r.k]) for r in got)


def test_empty_tables(spark):
    one = spark.createDataFrame([(1, [0.0, 1.0])], "k long, v array<double>")
    assert N.nearest(one, "k", one.limit(0), "k", "v").count() == 0 and N.nearest(one.limit(0), "k", one, "k", "v").count() == 0
