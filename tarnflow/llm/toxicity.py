"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are words (runs of letters, digits and non-ASCII characters, ASCII lower-cased) and six-byte beginnings of longer
words. All terms that two examples share are indexed; a term weighs its inverse document frequency, times ``UNLINKED`` plus how
strongly it goes with label 1 (the phi coefficient), so that a text is near to what it shares telling terms with. Examples are a
bounded sample of labelled rows (``MOST_LABELLED``); every whole text is a query against all of them. A text without an indexed
term (null and empty texts) is nearest to the examples without one, all alike, and scores their share of label 1. Equal similarities are taken in the order of the examples' ids. Rows may repeat; other columns
stay, those with an output name are replaced. Without labels of both kinds every score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import common as C
from tarnflow.llm.labelled import sample

MOST_LABELLED = 3000
NEAREST = 5
#: Least number of examples that hold an indexed term, and the share of its weight that doesn't depend on labels.
LEAST_EXAMPLES, UNLINKED = 2, 0.05
BEGINNING = 6
#: Examples of a block, and one in how many of them must hold a term for its postings to be a row.
BLOCK, OFTEN = 1024, 16
#: Votes of the base rate in every decision, and the share of examples by which a vote counts with distance.
PRIOR_VOTES = 0.5
THRESHOLD = 0.7
HELD_OUT = (3, 1)
EVIDENCE = 3
FIELDS = "score double, evidence array<struct<doc_id:string,similarity:double,label:int>>"
_PREFIX = np.uint64(0xBE61)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts, and the text of each."""
    w = C.Words(texts, C.WORD, lower=True)
    longer = np.flatnonzero(w.end - w.start > BEGINNING)
    begun = C.mix(C.span_hashes(w.data, w.start[longer], w.start[longer] + BEGINNING) ^ _PREFIX)
    return np.concatenate((w.hashes(), begun)), np.concatenate((w.doc, w.doc[longer]))


def linked(inside: np.ndarray, outside: np.ndarray, positive: int, negative: int) -> np.ndarray:
    """How strongly terms go with label 1, from 0 to 1 (the phi coefficient, 0 for terms that don't): of the examples with and
    without the label, ``inside`` and ``outside`` hold the term."""
    c, d = positive - inside, negative - outside
    spread = (inside + outside).astype(float) * (c + d) * positive * negative
    phi = (inside.astype(float) * d - outside.astype(float) * c) / np.sqrt(np.maximum(spread, 1.0))
    return np.where(spread > 0, np.clip(phi, 0.0, 1.0), 0.0)


Vector = tuple[np.ndarray, np.ndarray]


class Block:
    """Postings of a block of examples: a term that many of them hold as a row of weights, the others as lists."""

    def __init__(self, place: np.ndarray, example: np.ndarray, x: np.ndarray) -> None:
        """Terms in order with the examples (places in the block) that hold them, and the weights there."""
        terms_in, term, holds = np.unique(place, return_inverse=True, return_counts=True)
        often = holds * OFTEN >= BLOCK
        self.common, self.rare = terms_in[often], terms_in[~often]
        self.rows = np.zeros((len(self.common), BLOCK))
        dense = often[term]
        self.rows[(np.cumsum(often) - 1)[term[dense]], example[dense]] = x[dense]
        self.first = np.concatenate(([0], np.cumsum(holds[~often])))
        self.example, self.x = example[~dense].astype(np.int32), x[~dense]

    @staticmethod
    def _held(terms_in: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms ``at`` are among others, and their places there."""
        if not len(terms_in):
            return np.zeros(len(at), bool), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(terms_in, at), len(terms_in) - 1)
        hit = terms_in[place] == at
        return hit, place[hit]

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Cosine of a query with each example of the block."""
        hit, place = self._held(self.common, at)
        out = q[hit] @ self.rows[place]
        hit, place = self._held(self.rare, at)
        begin = self.first[place]
        size = self.first[place + 1] - begin
        postings = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return out + np.bincount(self.example[postings], self.x[postings] * np.repeat(q[hit], size), BLOCK)


class Index:
    """Examples as unit vectors over the terms that two of them share: by block of examples, postings (term, example, weight) in
    order, and by term the largest weight in each block."""

    def __init__(self, examples: list[tuple[str, int, np.ndarray, np.ndarray]]) -> None:
        """Of each example: id, label, hashed terms (ascending, once each) and their counts."""
        labels = np.array([y for _, y, *_ in examples], np.int32)
        total, positive = len(examples), int(labels.sum())
        self.base = (positive + 1) / (total + 2)
        of = np.repeat(np.arange(total), [len(t) for *_, t, _ in examples])
        hashed = np.concatenate([np.zeros(0, np.uint64), *(t for *_, t, _ in examples)])
        n = np.concatenate([np.zeros(0, np.int64), *(n for *_, n in examples)])
        self.vocabulary, place, holds = np.unique(hashed, return_inverse=True, return_counts=True)
        shared = holds >= LEAST_EXAMPLES
        renumbered = np.cumsum(shared) - 1
        kept = shared[place]
        place, of, n = renumbered[place[kept]], of[kept], n[kept]
        self.vocabulary, holds = self.vocabulary[shared], holds[shared]
        inside = np.bincount(place, labels[of], len(holds)).astype(np.int64)
        self.weights = (np.log((total + 1) / (holds + 1)) + 1) * (UNLINKED + linked(inside, holds - inside, positive, total - positive))
        x = (1 + np.log(n)) * self.weights[place]
        length = np.sqrt(np.bincount(of, x * x, total))
        held = np.flatnonzero(length > 0)
        zero = labels[length == 0]
        self.of_zero = (float(zero.sum()) + PRIOR_VOTES * self.base) / (len(zero) + PRIOR_VOTES)
        self.ids, self.labels = [examples[i][0] for i in held], labels[held]
        x = x / length[of]
        of = (np.cumsum(length > 0) - 1)[of]
        order = np.lexsort((of, place, of // BLOCK))
        place, of, x = place[order].astype(np.int32), of[order], x[order]
        blocks = -(-len(held) // BLOCK)
        self.most = np.zeros((len(holds), blocks))
        np.maximum.at(self.most, (place, of // BLOCK), x)
        cuts = np.searchsorted(of // BLOCK, np.arange(blocks + 1))
        self.blocks = [Block(place[a:b], of[a:b] % BLOCK, x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.scale = self.shift = None
        own = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[own], np.arange(len(held) + 1))
        self._calibrate([(place[own[a:b]], x[own[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)])

    def unit(self, at: np.ndarray, n: np.ndarray) -> Vector:
        """Weighted TF-IDF of term counts (by place in the vocabulary, ascending), of length 1."""
        x = (1 + np.log(n)) * self.weights[at]
        return at, x / np.sqrt(np.dot(x, x))

    def nearest(self, query: Vector, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest cosine above 0, (cosine, example), best first: blocks are scored in the order of
        their bound, the sum of the query's weights times the largest weights of the block, until no bound can reach the kth."""
        at, q = query
        bounds = q @ self.most[at]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1][0] - 1e-12:
                break
            scores = self.blocks[b].scores(at, q)
            if 0 <= without - b * BLOCK < BLOCK:
                scores[without - b * BLOCK] = 0.0
            least = max(np.partition(scores, BLOCK - k)[BLOCK - k], best[-1][0] if len(best) == k else 0.0)
            found = np.flatnonzero((scores > 0) & (scores >= least - 1e-12))
            best = sorted([*best, *((float(scores[j]), b * BLOCK + j) for j in found.tolist())], key=lambda p: (-round(p[0], 12), p[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Labels of the nearest weighted by 1 / (1 - cosine + 0.05), with the base rate as a small vote."""
        w = [1 / (1.05 - min(s, 1.0)) for s, _ in near]
        return (sum(x * int(self.labels[i]) for x, (_, i) in zip(w, near, strict=True)) + PRIOR_VOTES * self.base) / (sum(w) + PRIOR_VOTES)

    def _calibrate(self, vectors: list[Vector]) -> None:
        """Platt's scaling of votes against labels, each example voted on by the others; kept only if it leaves the order as it is."""
        if not len(set(self.labels.tolist())) > 1:
            return
        x = np.array([self.vote(self.nearest(v, NEAREST, i)) for i, v in enumerate(vectors)])
        y = (self.labels * self.labels.sum() + 1) / (self.labels.sum() + 2) * self.labels + (1 - self.labels) / ((1 - self.labels).sum() + 2)
        x = np.log(x / (1 - x))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
            w = p * (1 - p) + 1e-9
            h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
            step = np.linalg.solve(h, np.array([np.sum((y - p) * x) - 1e-3 * (a - 1), np.sum(y - p) - 1e-3 * b]))
            a, b = a + step[0], b + step[1]
        if a > 0 and math.isfinite(a) and math.isfinite(b):
            self.scale, self.shift = float(a), float(b)

    def score(self, query: Vector) -> tuple[float, list[tuple[float, int]]]:
        near = self.nearest(query, NEAREST)
        p = self.vote(near)
        if self.scale is not None:
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, self.scale * math.log(p / (1 - p)) + self.shift))))
        return p, near

    def queries(self, texts: list[bytes]) -> list[Vector]:
        """Places and counts of the vocabulary's terms in each text."""
        hashed, doc = terms(texts)
        if not len(self.vocabulary):
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashed
        pairs, counts = np.unique(doc[hit] * len(self.vocabulary) + at[hit], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(1, len(texts)) * len(self.vocabulary))
        return list(zip(np.split(pairs % len(self.vocabulary), cuts), np.split(counts, cuts), strict=True))


def _counts(batch: pa.RecordBatch) -> list[pa.Array]:
    keys, counts = [], []
    for _, texts in C.runs(batch["text"]):
        hashed, doc = terms(texts)
        for i in range(len(texts)):
            unique, n = np.unique(hashed[doc == i], return_counts=True)
            keys.append(unique.view(np.int64))
            counts.append(n.astype(np.int32))
    return [pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> Index:
    modulus, left_out = HELD_OUT
    rows = C.mapped(sample(docs, labels, label, C.fold("doc_id", modulus) != left_out, most), "terms array<long>, counts array<int>", _counts)
    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "terms", "counts").toArrow()
    ids, ys = found["doc_id"].to_pylist(), found["label"].to_pylist()
    keys, counts = C.pieces(found["terms"]), C.pieces(found["counts"])
    del found
    index = Index([(ids[i], ys[i], keys[i].view(np.uint64), counts[i]) for i in sorted(range(len(ids)), key=ids.__getitem__)])
    del keys, counts
    C.give_back()
    return index


def score(docs: DataFrame, index: Index, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``score`` and ``evidence``, the nearest examples; leaves out the columns ``without`` (the text may be one)."""
    shared: Any = docs.sparkSession.sparkContext.broadcast(index)

    def new(batch: pa.RecordBatch) -> list[pa.Array]:
        own, scores, evidence = shared.value, [], []
        for _, texts in C.runs(batch[text]):
            for counts in own.queries(texts):
                p, near = own.score(own.unit(*counts)) if len(counts[0]) else (own.of_zero, [])
                scores.append(p)
                evidence.append([{"doc_id": own.ids[i], "similarity": s, "label": int(own.labels[i])} for s, i in near[:EVIDENCE]])
        kind = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))
        return [pa.array(scores, pa.float64()), pa.array(evidence, kind)]

    return C.mapped(docs, FIELDS, new, without)
