"""Comparing the members of keys in groups of bounded size, whatever the size of a key.

A key of n rows is dealt into ceil(n / chunk) chunks, and each pair of its chunks is a group of its own: every two rows
of a key meet in exactly one group, and a group holds about two chunks at most. Groups stream through sorted partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import common as C

#: Keys with more rows than a chunk are broadcast up to this number, else joined.
MOST_BROADCAST = 500_000


def large(rows: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """(keys, count) of the keys of more than ``chunk`` rows."""
    return C.checkpointed(rows.groupBy(*keys).count().filter(F.col("count") > chunk))


def dealt(rows: DataFrame, keys: list[str], by: str, chunk: int, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``chunk`` and the pair (a, b) of chunks; ``by`` is the column whose hash deals the rows, ``counted`` the large
    keys where they are known."""
    many = (large(rows, keys, chunk) if counted is None else counted).select(*keys, F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    few = many.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    out = rows.join(F.broadcast(many) if few else many, keys, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    out = out.withColumn("chunk", F.pmod(F.xxhash64(by), F.col("n")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return out.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")}).drop("n", "other")


def compared(rows: DataFrame, keys: list[str], by: str, schema: str, flush: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """Runs ``flush(table, group, crossed)`` over whole groups: ``group`` numbers them, ascending; ``crossed`` is -1 in a
    group of one chunk, else the side (0 or 1), where only rows of different sides are to be compared. The rows of a group
    come in the order of ``by``, so that groups which share members tend to name a class by the same one."""
    group = [*keys, "a", "b"]

    def ended(table: pa.Table) -> pa.RecordBatch:
        fresh = np.zeros(len(table), bool)
        for c in group:
            column = np.asarray(table[c])
            fresh[1:] |= column[1:] != column[:-1]
        a, b = np.asarray(table["a"]), np.asarray(table["b"])
        return flush(table, np.cumsum(fresh), np.where(a == b, -1, (np.asarray(table["chunk"]) == b).astype(int)))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            same = np.ones(len(table), bool)
            for c in group:  # the last group may go on in the next batch
                column = np.asarray(table[c])
                same &= column == column[-1]
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            held = table.slice(cut)
            if cut:
                yield ended(table.slice(0, cut))
        if held is not None:
            yield ended(held)

    return rows.repartition(*group).sortWithinPartitions(*group, by).mapInArrow(stream, schema)


def near_rows(group: np.ndarray, crossed: np.ndarray, small: int) -> Iterator[tuple[int, np.ndarray]]:
    """For groups of up to ``small`` rows: (step, rows i to be compared with i + step)."""
    n = len(group)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(first, n))
    inside = np.repeat(sizes <= small, sizes)
    most = int(sizes[sizes <= small].max(initial=0))
    for step in range(1, most):
        i = np.flatnonzero((group[:-step] == group[step:]) & inside[:-step] & ((crossed[:-step] < 0) | (crossed[:-step] != crossed[step:])))
        if len(i):
            yield step, i


def large_groups(group: np.ndarray, crossed: np.ndarray, small: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of more than ``small`` rows: the rows of both sides; the same rows twice in a group of one chunk."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(first, len(group)))
    for at, size in zip(first[sizes > small], sizes[sizes > small], strict=True):
        rows = np.arange(at, at + size)
        sides = crossed[rows]
        left, right = (rows, rows) if sides[0] < 0 else (rows[sides == 0], rows[sides == 1])
        if len(left) and len(right):
            yield left, right
