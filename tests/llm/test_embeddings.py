import math

import numpy as np
import pytest

from tarnflow.llm import embeddings


def brute(rows, threshold=embeddings.THRESHOLD):
    """Pairs, then (n_links, component) of each row."""
    def valid(e, label):
        return label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    xs = [np.array(e, np.float64) if valid(e, label) else None for _, e, label in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = xs[i], xs[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    return [(n[i], least.get(find(i))) for i in range(len(rows))]


def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 60)):
            rows.append((centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.4])).astype(np.float32).tolist())
    rows = [(900 - i, e, int(rng.integers(0, 3))) for i, e in enumerate(rows)]
    one = [1.0] + [0.0] * 15
    return [*rows, (2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] + [0.0] * 15, 1), (2005, [None] + [1.0] * 15, 1), (2006, one, None), (2007, one, 9), (2008, one, 9), (2008, one, 9), (2009, [2.0] + [0.0] * 15, 9), (2010, [1.0, 0.0], 9), (None, one, 9), (None, None, 9)]


@pytest.mark.parametrize(("chunk", "small"), [(1024, 32), (3, 2)])
def test_agrees_with_brute_force(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "_SMALL", small)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    expected = sorted(((v, n, c, v is not None and v == c) for (v, *_), (n, c) in zip(rows, brute(rows), strict=True)), key=str)
    right = sum(a == b for a, b in zip(got, expected, strict=True))
    assert len(got) == len(rows) and right >= 0.99 * len(rows)
    assert [g for g in got if (g[0] or 9999) >= 2000] == [e for e in expected if (e[0] or 9999) >= 2000]
    assert all(n <= e[1] for (_, n, *_), e in zip(got, expected, strict=True))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    import duckdb

    from tarnflow.llm.queries import op7_embedding_dedup

    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select vec_id, embedding, label from '{folder}/embeddings.parquet'").fetchall()
    x = np.array([e for _, e, _ in rows], np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    label = np.array([-1 if y is None else y for *_, y in rows])
    near = ((x @ x.T) / np.outer(norms, norms) >= embeddings.THRESHOLD) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    expected = dict(zip((v for v, *_ in rows), near.sum(axis=1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in op7_embedding_dedup(spark, folder).collect()}
    assert got.keys() == expected.keys() and all(got[v] <= expected[v] for v in got)
    assert sum(got.values()) >= 0.99 * sum(expected.values())
