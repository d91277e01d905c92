"""Whitening of embeddings: mean, covariance and principal components from partial moments, merged in pairs.

Entries are put on a grid of 1/1024 and shifted (``gridded``), so that sums are exact whole numbers. Each partition keeps a
count, the sums, and the scatter centred at its own mean, batch by batch; two such are merged by Chan's formula
(scatter a + scatter b + the outer product of the difference of means, weighted by n_a n_b / n), in ``treeReduce``. What
leaves a task is one square matrix a vector length, and the driver sees the merged one only: ``eigh`` there. A second
pass takes the covariance of the whitened rows the same way and holds it against the identity.

Vectors that are null or hold null or non-finite entries are dropped. Vectors of different lengths are spaces of their own,
each with its mean, components and counts; empty vectors have no component and so no row. A component without
variance (at most 1e-12 of the trace) can't be scaled: ``whitened`` is null there, and the check leaves it out. Entries whose
place on the grid is beyond 2**53 are taken as 2**53. ``deviation`` is null where it doesn't fit a long. Rows may repeat,
each counts; a null id is carried as it is. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import give_back

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_MOST = 2.0**53
_FLAT = 1e-12
#: Vectors of a length that are worked on at once.
_ROWS = 4096

FIELDS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Count, sums (exact where the values are whole numbers), and scatter about the mean."""

    n: int
    sums: list[int] | list[float]
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, sums: list[int] | list[float]) -> Moments:
        d = x - np.array([s / len(x) for s in sums])
        rest = d.sum(axis=0)  # what rounding the mean has left
        return cls(len(x), sums, d.T @ d - np.outer(rest, rest) / len(x))

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        # The means' difference from whole numbers, so that nothing cancels.
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n))


Spaces = dict[int, Moments]


def both(a: Spaces, b: Spaces) -> Spaces:
    return {k: a[k].merged(b[k]) if k in a and k in b else a.get(k) or b[k] for k in sorted({*a, *b})}


def gridded(c: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000, whole numbers."""
    return np.clip(np.floor(SCALE * c), -_MOST, _MOST).astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    if not x.size or int(np.abs(x).max()) < (1 << 62) // len(x):
        return [int(s) for s in x.sum(axis=0)]
    return [sum(column) for column in x.T.tolist()]


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a column without null and non-finite entries, by length: (rows, entries as doubles)."""
    begins, ends = np.asarray(column.offsets)[:-1], np.asarray(column.offsets)[1:]
    values = column.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = np.asarray(column.is_valid()) & (bad[ends] == bad[begins])
    lengths = ends - begins
    for length in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == length))
        for part in np.array_split(rows, len(rows) // _ROWS + 1) if length else ():
            if len(part):
                yield part, flat[begins[part][:, None] + np.arange(length)]


def moments(vectors: DataFrame, column: str, taken: Callable[[np.ndarray], Moments | None]) -> Spaces:
    """The merged moments of all usable vectors; ``taken`` makes those of a few vectors of a length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Spaces = {}
        for batch in batches:
            for _, c in usable(batch[column]):
                made = taken(c)
                if made is not None:
                    found = both(found, {c.shape[1]: made})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["moments"])

    parts = vectors.select(column).mapInArrow(partial, "moments binary").rdd.map(lambda row: pickle.loads(row.moments))
    return parts.treeReduce(both) if parts.getNumPartitions() else {}


class Basis:
    """What the rows of a length are projected on: the fit's count and sums, unit eigenvectors of its covariance (columns, by
    falling eigenvalue) and their eigenvalues."""

    def __init__(self, fit: Moments, most: int) -> None:
        self.n, self.sums = fit.n, fit.sums
        values, directions = np.linalg.eigh(fit.scatter / fit.n)
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.directions = np.maximum(values[order], 0.0), directions[:, order]
        trace = float(np.trace(fit.scatter)) / fit.n
        self.explained = self.values / trace if trace > 0 else np.full(len(order), np.nan)
        self.scaled = self.values > _FLAT * trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN for a component without variance."""
        scale = np.sqrt(np.where(self.scaled, self.values, np.nan))
        return (x - np.array([s / self.n for s in self.sums])) @ self.directions / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) squared: in longs where none can overflow, else in Python's whole numbers."""
        rough = np.square(self.n * x.astype(np.float64) - np.array(self.sums, np.float64)).sum(axis=1)
        if self.n * int(np.abs(x).max()) < 1 << 62 and rough.max() < 2.0**62:
            return np.square(self.n * x - np.array(self.sums, np.int64)).sum(axis=1).tolist()
        out: list[int | None] = []
        for row, about in zip(x, rough, strict=True):
            exact = sum((self.n * v - s) ** 2 for v, s in zip(row.tolist(), self.sums, strict=True)) if about < 2.0**64 else 1 << 64
            out.append(exact if exact < 1 << 63 else None)
        return out


def whitened(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding", carry: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """One row for each usable vector and each of the first ``components`` components, with the columns ``carry`` and
    ``FIELDS``: the fit's count, the row's exact squared deviation times n squared, its whitened coordinate, the share of the
    variance that the component explains, and the largest error of the whitened covariance."""
    source = vectors.select(*[F.col(c) for c in carry], F.col(embedding).cast("array<double>").alias("_vector"))

    def raw(c: np.ndarray) -> Moments:
        x = gridded(c)
        return Moments.of(x, exact_sums(x))

    bases = {length: Basis(fit, components) for length, fit in moments(source, "_vector", raw).items()}
    shared = source.sparkSession.sparkContext.broadcast(bases)

    def projected(c: np.ndarray) -> Moments | None:
        basis = shared.value[c.shape[1]]
        w = basis.whitened(gridded(c))[:, basis.scaled]
        return Moments.of(w, w.sum(axis=0).tolist()) if w.shape[1] else None

    checked = moments(source, "_vector", projected)
    errors = {length: float(np.abs(m.scatter / m.n - np.eye(len(m.sums))).max()) for length, m in checked.items()}
    give_back()
    fields = T.StructType([*(source.schema[c] for c in carry), *T.StructType.fromDDL(FIELDS).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, c in usable(batch["_vector"]):
                basis, x = shared.value[c.shape[1]], gridded(c)
                k, m = len(basis.values), len(at)
                flat = basis.whitened(x).ravel()
                new = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, basis.n)),
                    pa.array(basis.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(basis.explained, m), mask=np.isnan(np.tile(basis.explained, m))),
                    pa.array([errors.get(c.shape[1])] * (m * k), pa.float64()),
                ]
                kept = batch.select(list(carry)).take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=fields.names)

    return source.mapInArrow(rows, fields)
