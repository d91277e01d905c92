import math
import random

import numpy as np
import pytest

from tarnflow.llm import quality, toxicity

EDGE = [(0, None), (1, ""), (2, "   \n"), (3, "!!!"), (4, "word " * 200000), (5, "same text"), (5, "same text"), (None, "no id")]


def edge_docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in EDGE], "doc_id long, text string, score string")


def held_out(rows, label):
    """Balanced accuracy over the rows that were not learned from."""
    hits = {0: [], 1: []}
    for r in rows:
        if r.held_out:
            hits[r[label]].append(r.predicted == r[label])
    return sum(sum(h) / len(h) for h in hits.values()) / 2


@pytest.mark.parametrize(("op", "label", "least"), [("op3_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.94)])
def test_held_out_accuracy(spark, op, label, least):
    from tarnflow.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    out = QUERIES[op](spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    assert held_out(rows, label) >= least
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)


def test_hashed_ngrams_equal_a_plain_count():
    texts = [b"One two two ONE!!", b"", b"\xc3\x89t\xc3\xa9!! A1 A1", b"x"]
    together = quality.features(texts)
    for i, t in enumerate(texts):
        alone = quality.features([t])
        n = len(t.split())
        for (hashed, first), (own, _), (_, size) in zip(together, alone, quality.SORTS, strict=False):
            assert hashed[first[i] : first[i + 1]].tolist() == own.tolist() and len(own) == max(0, n - size + 1)
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    for t, m in zip(texts, quality.margins(texts, weights), strict=True):
        dense = np.zeros(1 << quality.BITS)
        for hashed, _ in quality.features([t]):
            np.add.at(dense, hashed, 1 / max(len(hashed), 1))
        assert abs(dense @ weights[:-1] + weights[-1] - m) < 1e-4


def test_quality_edge_cases(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (1, 1), (77, 1)], "doc_id long, quality int")
    for given in (none, labels):
        got = quality.score(docs, quality.train(docs, given)).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(EDGE)


def test_block_max_search_is_exact(monkeypatch):
    rng = random.Random(3)
    words = [f"term{i}" for i in range(60)]
    examples = []
    for i in range(500):
        y = int(rng.random() < 0.3)
        own = [w for k, w in enumerate(words) if rng.random() < (0.15 if y and k < 40 else 0.04)]
        hashed, _ = toxicity.terms([" ".join(own).encode()])
        hashed = np.unique(hashed)
        examples.append((f"{i:04d}", y, hashed, np.array([rng.randint(1, 4) for _ in hashed])))
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    index = toxicity.Index(examples)
    held = {t: sum(t in ts for *_, ts, _ in examples) for *_, ts, _ in examples for t in ts.tolist()}
    assert index.vocabulary.tolist() == sorted(t for t, n in held.items() if n >= 2)
    positive = sum(y for _, y, *_ in examples)
    at = {t: k for k, t in enumerate(index.vocabulary.tolist())}

    def weight(t):
        a = sum(y for _, y, ts, _ in examples if t in ts)
        b = held[t] - a
        c, d = positive - a, len(examples) - positive - b
        phi = (a * d - b * c) / math.sqrt((a + b) * (c + d) * positive * (len(examples) - positive))
        return (math.log((len(examples) + 1) / (held[t] + 1)) + 1) * (toxicity.UNLINKED + max(0.0, phi))

    weights = {t: weight(t) for t in at}

    def vector(ts, ns):
        raw = {t: (1 + math.log(n)) * weights[t] for t, n in zip(ts.tolist(), ns.tolist(), strict=True) if t in at}
        return {t: x / math.sqrt(sum(v * v for v in raw.values())) for t, x in raw.items()}

    vectors = [v for *_, ts, ns in examples if (v := vector(ts, ns))]
    assert len(vectors) == len(index.ids)
    for without, q in enumerate(vectors[:80]):
        for left_out in (-1, without):
            exact = sorted(((sum(x * v.get(t, 0.0) for t, x in q.items()), i) for i, v in enumerate(vectors) if i != left_out), key=lambda p: (-round(p[0], 12), p[1]))
            exact = [p for p in exact if p[0] > 0][: toxicity.NEAREST]
            order = sorted(q, key=at.__getitem__)
            got = index.nearest((np.array([at[t] for t in order]), np.array([q[t] for t in order])), toxicity.NEAREST, left_out)
            assert [i for _, i in got] == [i for _, i in exact] and np.allclose([s for s, _ in got], [s for s, _ in exact])
    # the vote, by hand
    near = [(1.0, 0), (0.5, 1)]
    votes = [1 / 0.05, 1 / 0.55]
    want = (sum(w * index.labels[i] for w, (_, i) in zip(votes, near, strict=True)) + toxicity.PRIOR_VOTES * index.base) / (sum(votes) + toxicity.PRIOR_VOTES)
    assert index.vote(near) == pytest.approx(want)


def test_every_text_with_a_shared_term_has_evidence(spark):
    docs = spark.createDataFrame([(i, f"alpha word{i % 7} vile" if i % 3 == 0 else f"alpha word{i % 7} kind") for i in range(60)] + [(100, "nothing here"), (101, "alpha"), (102, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(len(r.evidence) == (0 if k in (100, 102) else toxicity.EVIDENCE) for k, r in got.items())
    assert min(got[i].score for i in range(0, 60, 3)) > 0.5 > max(got[i].score for i in range(60) if i % 3)
    assert {e.label for e in got[0].evidence} == {1} and got[100].score == got[102].score


def test_toxicity_edge_cases(spark):
    docs = edge_docs(spark)
    for given in ([(0, None)], [(4, 1), (5, 0), (5, 0), (3, 1)]):
        labels = spark.createDataFrame(given, "doc_id long, toxic int")
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
