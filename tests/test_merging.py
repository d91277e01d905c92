"""Merging many pairs a round gives what merging one pair after another gives."""

import random

import pytest

from tarnflow.operators.merging import merged

APART = 100
BETA, FREE, LEAST = 0.7, 6.0, 3.0


def one_after_another(regions, pairs):
    """The rule as it is said: look at all pairs, merge the first in order, look again."""
    peak, size = {k: p for k, p, _ in regions}, {k: s for k, _, s in regions}
    into = {k: k for k in peak}
    wide = {}
    for a, b, w in pairs:
        if a != b:
            k = (min(a, b), max(a, b))
            wide[k] = min((-w, *k), wide.get(k, (0.0, *k)))
    while True:
        may = []
        for (a, b), (n, u, v) in wide.items():
            low, small = min(peak[a], peak[b]), min(size[a], size[b]) < LEAST
            if -n >= BETA * low or -n >= FREE or small:
                may.append((not small, n / max(low, 1e-300), u, v, a, b))
        if not may:
            return into
        *_, a, b = min(may)
        peak[a], size[a] = max(peak[a], peak[b]), size[a] + size[b]
        into = {k: a if r == b else r for k, r in into.items()}
        joined = {}
        for (x, y), way in wide.items():
            x, y = sorted((a if x == b else x, a if y == b else y))
            if x != y:
                joined[x, y] = min(way, joined.get((x, y), way))
        wide = joined


def graph(rng, first):
    n = rng.randint(1, 9)
    regions = [(first + k, float(rng.randint(0, 8)), float(rng.randint(1, 5))) for k in range(n)]
    kind = rng.random()
    if kind < 0.2:  # a hub
        ends = [(0, k) for k in range(1, n)]
    elif kind < 0.4:  # a chain
        ends = [(k, k + 1) for k in range(n - 1)]
    else:
        ends = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]
    return regions, [(first + a, first + b, rng.randint(1, 16) / 2) for a, b in ends]


@pytest.mark.parametrize(("few", "many"), [(0, 10_000), (10**9, 1000)])
def test_random_graphs(spark, few, many):
    rng = random.Random(8)
    regions, pairs, want = [], [], {}
    for g in range(many):
        r, p = graph(rng, g * APART)
        regions.extend(r)
        pairs.extend(p)
        want |= one_after_another(r, p)
    got = merged(spark.createDataFrame(regions, "label long, peak double, size double"), spark.createDataFrame(pairs, "a long, b long, opening double"), BETA, FREE, LEAST, few)
    rows = got.collect()
    assert len(rows) == len(want)
    wrong = [(r.label, r.into, want[r.label]) for r in rows if r.into != want[r.label]]
    assert not wrong, (len(wrong), wrong[:3])


def test_a_hub_and_a_long_chain_take_few_rounds(spark):
    hub = [(k, 5.0 if k == 0 else 1.0, 9.0) for k in range(400)]
    chain = [(1000 + k, 1.0, 9.0) for k in range(400)]
    pairs = [(0, k, 1 + k / 100) for k in range(1, 400)] + [(1000 + k, 1001 + k, 1 + k / 100) for k in range(399)]
    got = merged(spark.createDataFrame(hub + chain, "label long, peak double, size double"), spark.createDataFrame(pairs, "a long, b long, opening double"), BETA, FREE, 0.0, few=0).collect()
    assert {r.into for r in got} == {0, 1000}


def test_edge_cases(spark):
    regions = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 1.0), (3, None, 1.0)], "label long, peak double, size double")
    pairs = spark.createDataFrame([(1, 2, 1.9), (2, 1, 1.9), (1, 1, 9.0), (1, 77, 9.0), (None, 2, 9.0), (2, 3, None)], "a long, b long, opening double")
    for few in (0, 100):
        assert {(r.label, r.into) for r in merged(regions, pairs, few=few).collect()} == {(1, 1), (2, 1), (3, 3)}
        assert merged(regions.limit(0), pairs, few=few).count() == 0 and merged(regions, pairs.limit(0), few=few).count() == 3
