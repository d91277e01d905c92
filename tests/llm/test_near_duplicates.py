import random

import corpus_pipeline
import numpy as np
from tests_llm_brute import jaccard_components

from tarnflow.llm import bitsliced, simhash


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())


def test_texts_that_differ_in_repeats_only_are_near_duplicates(spark):
    rng = random.Random(8)
    texts = []
    for k in range(20):
        lines = [" ".join(f"line{k}x{i}w{rng.randrange(10**6)}" for _ in range(10)) for i in range(20)]
        texts += [" ".join(lines), " ".join(lines[:1] * 40 + lines)]  # line 0 follows itself: five shingles are new
    assert kept_ids(spark, texts) == list(range(0, 40, 2))


def test_short_texts_meet_exactly(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(10**5)]
    common = " ".join(rng.choice(words) for _ in range(9))
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(9)]
        texts += [" ".join(base[:8]), " ".join(base)]  # 4 and 5 shingles: 0.8
    for k in range(40):  # one common line in each
        texts.append(common + " " + " ".join(rng.choice(words) for _ in range(12)))
    rows = list(enumerate(texts))
    groups = {}
    for (d, _), c in zip(rows, jaccard_components(rows), strict=True):
        groups.setdefault(c, d)
    assert kept_ids(spark, texts) == sorted(groups.values())
    assert len(groups) == 100


def test_no_pair_at_the_threshold_is_lost_whatever_is_common(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "HOT", 16)  # the passage is a common one, and so are what it puts first
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = " ".join(word() for _ in range(30))
    texts, expected = [], []
    for k in range(60):
        shared, own = [[word() for _ in range(n)] for n in (rng.choice([44, 84, 404]), 0)]
        grams = len(shared) - 4
        own = [word() for _ in range(grams // 8)]  # on each side: an eighth of what is shared, so 0.8
        far = [word() for _ in range(grams // 8 + 1)]
        expected += [len(texts), len(texts) + 2]
        texts += [" ".join([*shared, *own]), " ".join([*shared, *[word() for _ in own]]), " ".join([*shared, *far, *far[:3]])]
    expected += list(range(len(texts), len(texts) + 40))
    texts += [" ".join([passage, *(word() for _ in range(20))]) for _ in range(40)]
    rows = list(enumerate(texts))
    groups = {}
    for (d, _), c in zip(rows, jaccard_components(rows), strict=True):
        groups.setdefault(c, d)
    assert kept_ids(spark, texts) == sorted(groups.values()) and len(groups) < len(texts) - 50


def test_first_shingles_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(13)
    for _ in range(300):
        both = rng.integers(0, 2**63, rng.integers(4, 200)).astype(np.uint64)
        extra = len(both) // 4
        left = rng.integers(0, extra + 1)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, n).astype(np.uint64)))) for n in (left, extra - left))
        order = simhash.Order({int(h): int(rng.integers(1, 9)) for h in rng.choice(both, len(both) // 3, replace=False)})
        assert len(both) >= 0.8 * (len(both) + extra) and set(order.first(a, 0.8).tolist()) & set(order.first(b, 0.8).tolist())


def test_equal_fingerprints_are_no_proof(spark, monkeypatch):
    rng = random.Random(10)
    own = [" ".join(f"own{rng.randrange(10**6)}" for _ in range(20)) for _ in range(12)]
    texts = [f"{t} {'For ' * 100}" for t in own]  # one shingle fills over half of the positions
    assert kept_ids(spark, [*texts, texts[3], f"{texts[5]} For"]) == list(range(12))
    whole = simhash.fingerprint
    monkeypatch.setattr(simhash, "fingerprint", lambda hashes, words=1: whole(hashes[:0], words))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(70)]
    assert kept_ids(spark, [*texts, *texts[:5]]) == list(range(70))


def test_exact_forest_joins_similar_sets_in_blocks_of_any_size():
    rng = np.random.default_rng(11)
    bases = [rng.integers(0, 2**63, 30).astype(np.uint64) for _ in range(9)]
    sets = []
    for _ in range(300):
        base = bases[rng.integers(9)]
        own = rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)
        sets.append(np.unique(np.concatenate((rng.choice(base, rng.integers(26, 31), replace=False), own))))
    group = np.sort(np.concatenate((np.zeros(200, int), rng.integers(1, 12, 100))))
    crossed = np.where(group == 0, rng.integers(0, 2, 300), -1)
    held = [set(s.tolist()) for s in sets]
    near = [(i, j) for i in range(300) for j in range(i) if group[i] == group[j] and (crossed[i] < 0 or crossed[i] != crossed[j]) and len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j])]

    def roots(pairs):
        labels = np.arange(300)
        for a, b in pairs:
            bitsliced.merge(labels, np.array([a]), np.array([b]))
        return labels.tolist()

    assert len(near) > 50
    assert roots(zip(*simhash.exact_forest(sets, group, crossed, 0.8), strict=True)) == roots(near)
