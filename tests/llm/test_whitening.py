"""Whitening: partial moments against whole-number arithmetic and a dense solver."""

import math
from fractions import Fraction

import numpy as np

from tarnflow.llm import whitening
from tarnflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_whole_table(spark):
    rows = [r for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
    x = np.array([[math.floor(1024 * v) + 100000 for v in r.embedding] for r in rows], dtype=object)
    n, sums = len(rows), x.sum(axis=0)
    centred = np.array([[float(Fraction(int(n * v - s), n)) for v, s in zip(row, sums, strict=True)] for row in x])
    v = centred.T @ centred / n
    values, directions = np.linalg.eigh(v)
    order = np.argsort(-values)[:8]
    white = centred @ directions[:, order] / np.sqrt(values[order])
    out = QUERIES["op13_whitening"](spark, FOLDER)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(got) == 8 * n
    for k in range(8):
        mine = np.array([got[r.vec_id, k + 1].whitened for r in rows])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-7
        assert abs(got[rows[0].vec_id, k + 1].explained / (values[order[k]] / np.trace(v)) - 1) < 1e-9
    for r, row in zip(rows, x, strict=True):
        g = got[r.vec_id, 1]
        assert g.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) and g.n == n
    assert {g.identity_error for g in got.values()} == {got[rows[0].vec_id, 1].identity_error} and g.identity_error < 1e-9


def test_merging_in_any_order_equals_one_pass():
    rng = np.random.default_rng(5)
    x = rng.integers(-700, 700, (5000, 7)) + 100000
    cuts = [0, 1, 2, 900, 901, 4000, 5000]
    parts = [whitening.Moments.of(x[a:b], whitening.exact_sums(x[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    left = parts[0]
    for p in parts[1:]:
        left = left.merged(p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = p.merged(right)
    whole = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    for m in (left, right):
        assert m.n == 5000 and m.sums == x.sum(axis=0).tolist() and np.allclose(m.scatter, whole, rtol=1e-12, atol=1e-6)


def test_edge_cases(spark):
    good = [[0.1, 0.2, 0.3], [0.5, -0.2, 0.3], [-0.4, 0.1, 0.9], [0.5, -0.2, 0.3]]
    bad = [None, [], [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0]]
    rows = [(i, v, -1, "x") for i, v in enumerate([*good, *bad])] + [(None, [0.3, 0.3, 0.1], -1, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened string")
    got = whitening.whitened(vectors).collect()
    assert len(got) == 15 and {r.n for r in got} == {5} and {r.vec_id for r in got} == {0, 1, 2, 3, None}
    same = {(r.component, r.whitened) for r in got if r.vec_id == 1} ^ {(r.component, r.whitened) for r in got if r.vec_id == 3}
    assert not same and max(r.identity_error for r in got) < 1e-9
    assert whitening.whitened(vectors.limit(0)).count() == 0
    assert whitening.whitened(vectors.filter("embedding is null")).count() == 0


def test_without_variance_and_with_huge_entries(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(flat).collect()
    assert len(got) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and all(r.identity_error < 1e-9 for r in got)
    huge = spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 4.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(huge).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)
    mixed = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0, 1.0]), (4, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component, r.n) for r in whitening.whitened(mixed).collect()) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]


def test_long_sums_stay_exact():
    x = np.array([[1 << 53, -3], [(1 << 53) - 1, 5], [1 << 53, 0]]).repeat(600, axis=0)
    assert whitening.exact_sums(x) == [sum(c) for c in x.T.tolist()]
    basis = whitening.Basis(whitening.Moments.of(x, whitening.exact_sums(x)), 2)
    assert basis.deviations(x)[::600] == [sum((1800 * int(v) - s) ** 2 for v, s in zip(row, basis.sums, strict=True)) for row in x[::600]]
