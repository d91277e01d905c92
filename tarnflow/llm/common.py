"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.operators.session import checkpointed as checkpointed

#: Texts are tokenised in runs of about this many bytes, which bounds the memory of a task.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def byte_class(text: str, high: bool) -> np.ndarray:
    """A table over byte values: true for the characters of ``text`` and, if ``high``, for all bytes from 0x80."""
    table = np.zeros(256, bool)
    table[np.frombuffer(text.encode("latin-1"), np.uint8)] = True
    table[128:] = high
    return table


#: ASCII white space, and letters and digits with all non-ASCII characters.
SPACE = byte_class(" \t\n\v\f\r", False)
NOT_SPACE = ~SPACE
WORD = byte_class("0123456789abcdefghijklmnopqrstuvwxyz", True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_powers = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span values[start:end], equal for equal spans, from one prefix sum."""
    up, down = _powers.to(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a run of texts: ``start``/``end`` into ``data`` (bytes), ``doc`` the row in the run,
    ``first`` the index of each row's first word (with the total at the end)."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool) -> None:
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        self.data = LOWER[data] if lower else data
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = table[self.data]
        inside[self.offsets[1:]] = 0  # the separator ends a word whatever the table says
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, by position of the first."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - n + 1)
    return span_hashes(hashes, at, at + n)


def runs(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Cuts a column of texts (null: empty) into runs of at most ``most`` bytes, one text at least: (first row, texts)."""
    at, out, total = 0, [], 0
    for i, value in enumerate(column):
        text = (value.as_py() or "").encode()
        if out and total + len(text) > most:
            yield at, out
            at, out, total = i, [], 0
        out.append(text)
        total += len(text)
    if out:
        yield at, out


def mapped(df: DataFrame, fields: str, new: Callable[[pa.RecordBatch], list[pa.Array]], without: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns (``fields`` as DDL) that ``new`` computes from Arrow batches; columns of the same names are replaced, those
    named by ``without`` go in and don't come out again."""
    added = T.StructType.fromDDL(fields)
    rest = df.drop(*added.names)
    kept = [f for f in rest.schema.fields if f.name not in without]
    names = [f.name for f in kept]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *new(batch)], names=[*names, *added.names])

    return df.mapInArrow(batches, T.StructType([*kept, *added.fields]))


def pieces(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of one array, without a Python object for each element."""
    joined = column.combine_chunks()
    joined = joined.chunk(0) if isinstance(joined, pa.ChunkedArray) else joined
    if not len(joined):
        return []
    at = np.asarray(joined.offsets)
    flat = np.asarray(joined.values)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def give_back() -> None:
    """Returns what Arrow holds but doesn't use to the system, after a sample was learned from on the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
