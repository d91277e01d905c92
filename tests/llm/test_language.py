"""Language identification: the forward algorithm against every segmentation, learning, held-out texts."""

import math
import random

import numpy as np

from tarnflow.llm import language as L
from tarnflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
FEW = ["a", "b", "ab", "ba", "aab", "é", "bé", "▁", "▁a", "▁ab", "▁é", "▁▁", "A", "a1"]


def words_of(texts):
    w, start, end, doc = L.cut_words([t.encode() for t in texts])
    words, place = L.unique_words(w, start, end)
    return words, place, sum(len(g.at) for g in words), doc


def segmentations(word: bytes, inner: dict[bytes, int], first: dict[bytes, int]):
    """Every way to write a word behind its mark: lists of piece numbers."""

    def rest(at):
        if at == len(word):
            yield []
            return
        for k in range(at + 1, len(word) + 1):
            own = [inner[word[at:k]]] if word[at:k] in inner else []
            if k == at + 1:
                own.append(word[at])
            for piece in own:
                for more in rest(k):
                    yield [piece, *more]

    yield from ([L.Pieces.MARK, *more] for more in rest(0))
    for k in range(1, len(word) + 1):
        if word[:k] in first:
            yield from ([first[word[:k]], *more] for more in rest(k))


def listed(texts):
    """The numbers that the vocabulary must give: bytes, mark, then pieces of letters in order."""
    inner = sorted({p for p in texts if not p.startswith("▁")})
    first = sorted({p.removeprefix("▁") for p in texts if p.startswith("▁")})
    ok = lambda p: p.encode() and all(chr(c) in "abcdefghijklmnopqrstuvwxyz" or c > 127 for c in p.encode())
    numbers, out = 257, ({}, {})
    for group, into in ((inner, out[0]), (first, out[1])):
        for p in group:
            if ok(p):
                into[p.encode()], numbers = numbers, numbers + 1
    return out, numbers


def test_forward_sums_all_segmentations_and_counts_their_pieces():
    known = L.Pieces(FEW)
    (inner, first), size = listed(FEW)
    assert known.size == size
    rng = np.random.default_rng(2)
    weights = rng.dirichlet(np.ones(size), 3).T
    texts = ["aabba ab é bé", "aé ba ba", "b", "abababab"]
    words, place, unique, doc = words_of(texts)
    every = [w.encode() for t in texts for w in t.split()]
    assert len(place) == len(every)
    got = L.log_probabilities(known, words, unique, weights)[place]
    counts = np.zeros((unique, 3))
    np.add.at(counts, place, [[1, 2, 0.5]] * len(place))
    found = L.expected(known, words, counts, weights)
    want = np.zeros_like(found)
    for row, word in zip(got, every, strict=True):
        ways = list(segmentations(word, inner, first))
        for lang in range(3):
            shares = np.array([math.prod(weights[p, lang] for p in way) for way in ways])
            assert abs(row[lang] - math.log(shares.sum())) < 1e-9
            for way, share in zip(ways, shares / shares.sum(), strict=True):
                for p in way:
                    want[p, lang] += share * (1, 2, 0.5)[lang]
    assert np.allclose(found, want)


def test_trie_finds_just_its_pieces():
    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(300)})
    known = L.Pieces(texts)
    data = "".join(rng.choice("abcé") for _ in range(400)).encode()[:64]
    found = {(i, j) for i, j, _, piece in L.arcs(known, np.frombuffer(data, np.uint8)[None, :]) if i >= 0 and piece[0] > 256}
    encoded = {t.encode() for t in texts}
    assert found == {(i, j) for i in range(64) for j in range(i + 1, 65) if data[i:j] in encoded}


def test_each_round_of_learning_raises_the_likelihood():
    known = L.pieces(L.VOCABULARY)
    words, place, unique, _ = words_of(["the weather was better than the others said it would be", "nothing whatsoever about the weather"])
    counts = np.bincount(place, minlength=unique)[:, None].astype(float)
    weights, before = np.full((known.size, 1), 1 / known.size), -np.inf
    for _ in range(4):
        now = float((L.log_probabilities(known, words, unique, weights) * counts).sum())
        assert now > before
        before, table = now, L.expected(known, words, counts, weights)
        weights = table / table.sum()
        weights = np.maximum(weights, 1e-12)


def test_long_runs_are_cut_at_characters():
    w, start, end, doc = L.cut_words([("é" * 100 + " ab").encode(), b"", ("x" * 200).encode()])
    pieces = sorted((d, w.data[a:b].tobytes()) for a, b, d in zip(start, end, doc, strict=True))
    assert all(p.decode() and len(p) <= L.LONGEST for _, p in pieces)
    assert sum(len(p) for d, p in pieces if d == 0) == 202 and sum(len(p) for d, p in pieces if d == 2) == 200


def test_held_out_accuracy(spark):
    out = QUERIES["op11_language"](spark, FOLDER)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    own = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(own) > 150 and sum(own) / len(own) >= 0.98


TEXTS = [
    (1, "the weather is nice and the people are happy", "en"), (3, "this is another sentence that they wrote", "en"), (4, "das wetter ist schön und die leute sind froh", "de"),
    (5, "dies ist noch ein satz, den sie geschrieben haben", "de"), (6, None, "en"), (7, "12 + 34", "de"), (8, "", None), (9, "the last one", None), (1, "the weather is nice and the people are happy", "en"), (None, "no id", "fr"), (10, "z" * 300000, "en"),
]


def test_edge_cases_and_rounds(spark):
    docs = spark.createDataFrame([(*t, 0.5, "x") for t in TEXTS], "doc_id long, text string, lang string, score double, piece string")
    for rounds in (1, 3):
        model = L.train(docs, rounds=rounds)
        assert model.languages == ["de", "en"] and np.allclose(model.weights.sum(axis=0), 1)
        got = L.identified(docs, model)
        assert sorted(got.columns) == ["doc_id", "lang", "lang_pred", "piece", "score", "text"]
        rows = got.collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            assert (r.lang_pred == "und") == (r.doc_id in (6, 7, 8)) and 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
        said = {r.doc_id: r.lang_pred for r in rows}
        assert said[1] == said[9] == "en" and said[4] == said[5] == "de"
    nothing = L.train(docs.filter("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in L.identified(docs, nothing).collect()} == {("und", 0.0)}
    assert L.identified(docs.limit(0), model).count() == 0


def test_counts_of_all_texts_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(TEXTS)], "doc_id long, text string, lang string")
    one, many = L.train(docs.coalesce(1)), L.train(docs.repartition(7))
    assert one.languages == many.languages and np.allclose(one.weights, many.weights) and np.allclose(one.prior, many.prior)
