"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are white-space separated words, as they are (ASCII lower-cased) and as shapes (runs of letters of a case, digits
and each punctuation mark, one character a run; a word that repeats the one before has a shape of its own). Features are
hashed 1- and 2-grams of words and 1- to 3-grams of shapes; a feature's value is its share of the n-grams of its sort.
Learns from a bounded sample of labelled rows (``MOST_LABELLED``), on the driver; scores every whole text as a sparse
dot product, without a shuffle. Null and empty texts have one feature of their own. Rows may repeat; other columns stay,
those with an output name are replaced. Without labels of both kinds every score is the smoothed share of label 1.
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

BITS = 18
#: (shapes, n): the sorts of n-grams.
SORTS = ((False, 1), (False, 2), (True, 1), (True, 2), (True, 3))
MOST_LABELLED = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.5, 1.0, 0.02, 0.05
#: What is no document's score of label 1 is rejected below this.
THRESHOLD = 0.3
HELD_OUT = (5, 0)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1], _SHAPE[ord("A") : ord("Z") + 1], _SHAPE[ord("0") : ord("9") + 1] = ord("a"), ord("A"), ord("0")
_EMPTY, _REPEATS, _FIRST = np.uint64(0x51), np.uint64(0x5EED), np.uint64(0x1D)


def _shapes(w: C.Words, hashes: np.ndarray) -> np.ndarray:
    kinds = _SHAPE[w.data]
    kept = kinds < 128
    kept[1:] &= (kinds[1:] != kinds[:-1]) | C.SPACE[w.data[:-1]]
    at = np.concatenate(([0], np.cumsum(kept)))
    out = C.span_hashes(kinds[kept], at[w.start], at[w.end])
    again = np.zeros(len(out), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    return np.where(again, _REPEATS, out)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each sort of n-grams: the hashed features of all texts, and the index of each text's first (with the total at the end)."""
    w = C.Words(texts, C.NOT_SPACE, lower=True)
    cased = C.Words(texts, C.NOT_SPACE, lower=False)
    words = w.hashes()
    tokens = {False: words, True: _shapes(cased, words)}
    out = []
    for k, (shapes, n) in enumerate(SORTS):
        grams = C.windows(tokens[shapes], n)
        inside = w.doc[: len(grams)] == w.doc[n - 1 :] if len(grams) else np.zeros(0, bool)
        hashed = (C.mix(grams[inside] + np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int32)
        counts = np.bincount(w.doc[: len(grams)][inside], minlength=len(texts))
        out.append((hashed, np.concatenate(([0], np.cumsum(counts)))))
    none = np.diff(w.first) == 0
    out.append((np.full(none.sum(), C.mix(np.array([_EMPTY]))[0] >> np.uint64(64 - BITS), np.int32), np.concatenate(([0], np.cumsum(none)))))
    return out


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """weights . x + bias of each text; the bias is the last weight."""
    out = np.full(len(texts), weights[-1], np.float64)
    for hashed, first in features(texts):
        sums = np.concatenate(([0.0], np.cumsum(weights[hashed], dtype=np.float64)))
        n = np.diff(first)
        out += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """FTRL-proximal, one row (indices, values, label) after another: each coordinate keeps a sum z of gradients, corrected
    so that its weight stays the leader's, and n of squared gradients, and is 0 while |z| is within L1."""
    size = (1 << BITS) + 1
    positive = sum(y for *_, y in rows)
    if not 0 < positive < len(rows):
        out = np.zeros(size)
        out[-1] = math.log((positive + 1) / (len(rows) - positive + 1))
        return out.astype(np.float32)
    z, n = np.zeros(size), np.zeros(size)

    def weight(at: Any) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            w = weight(at)
            g = (_sigmoid(np.dot(w, x)) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weight(slice(None)).astype(np.float32)


def _vectors(batch: pa.RecordBatch) -> list[pa.Array]:
    """Sparse features with the bias, for training."""
    indices, values = [], []
    for _, texts in C.runs(batch["text"]):
        found = features(texts)
        for i in range(len(texts)):
            at = [hashed[first[i] : first[i + 1]] for hashed, first in found]
            x = np.concatenate([np.full(len(a), 1 / max(len(a), 1)) for a in at] + [[1.0]])
            unique, where = np.unique(np.concatenate([*at, [1 << BITS]]), return_inverse=True)
            indices.append(unique.astype(np.int32))
            values.append(np.bincount(where, x).astype(np.float32))
    return [pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> np.ndarray:
    modulus, left_out = HELD_OUT
    rows = C.mapped(sample(docs, labels, label, C.fold("doc_id", modulus) != left_out, most), "indices array<int>, weights array<float>", _vectors)
    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "indices", "weights").toArrow()
    ids, ys = found["doc_id"].to_pylist(), found["label"].to_pylist()
    at, x = C.pieces(found["indices"]), C.pieces(found["weights"])
    del found
    weights = fit([(at[i], x[i], ys[i]) for i in sorted(range(len(ids)), key=ids.__getitem__)])
    del at, x
    C.give_back()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score", without: tuple[str, ...] = ()) -> DataFrame:
    """Adds the probability of label 1; leaves out the columns ``without`` (the text may be one)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def new(batch: pa.RecordBatch) -> list[pa.Array]:
        out = [_sigmoid(margins(texts, shared.value)) for _, texts in C.runs(batch[text])]
        return [pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())]

    return C.mapped(docs, f"{name} double", new, without)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold; columns as they were."""
    inner = docs.select(*(F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns)))
    scored = score(inner, train(docs, labels), f"_in_{docs.columns.index('text')}", "_score")
    return scored.filter(F.col("_score") >= threshold).select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)))
