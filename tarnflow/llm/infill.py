"""Fill-in-the-middle: a text is cut at two of its token boundaries and its pieces are put in another order between marks.

A token is a run of white space with the run of other characters after it, or white space at the end. A text is decoded to
UTF-32, one element a code point; where white space follows something else, found by comparing neighbours, a token
begins. Cuts, and whether and how a text is rearranged, come from four numbers of a digest of the seed and ``doc_id``, so
they are the same in every run and whatever the partitions.

``transformed`` adds ``fim_text`` with the counts below; ``restored`` is a Column that gives the text back. A null text is
empty; an empty text, or one that holds a mark, stays plain. A null id is digested as no digits. Rows may repeat and get the
same result; columns of the input that carry an output name are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm import common as C

#: The marks before prefix, suffix and middle, and white space (code points).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SEED, RATE, SUFFIX_FIRST = 42, 50, 80

FIELDS = "fim_text string, n long, form string, prefix_chars long, middle_chars long"

_SPACE = np.zeros(128, bool)
_SPACE[list(SPACE)] = True


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))  # type: ignore[return-value]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where each token of a text (code points) begins, and the text's length at the end."""
    if not len(points):
        return np.zeros(1, np.int64)
    space = _SPACE[np.minimum(points, 127)]
    return np.concatenate(([0], np.flatnonzero(space[1:] & ~space[:-1]) + 1, [len(points)]))


def rearranged(text: str, drawn: tuple[int, int, int, int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, str, int | None, int | None]:
    """(output, tokens, form, characters of the prefix, of the middle) of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = boundaries(points)
    n = len(at) - 1
    h1, h2, h3, h4 = drawn
    if not n or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return text, n, "plain", None, None
    a, b = at[np.sort([h1 % (n + 1), h2 % (n + 1)])]
    prefix, middle, suffix = (piece.tobytes().decode("utf-32-le") for piece in (points[:a], points[a:b], points[b:]))
    if h4 % 100 < suffix_first:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", n, "spm", int(a), int(b - a)
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", n, "psm", int(a), int(b - a)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, text: str = "text", doc_id: str = "doc_id", without: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``FIELDS``: the rearranged text, its number of tokens, its form (plain, psm, spm) and where it was cut. ``rate``
    in a hundred texts are rearranged, ``suffix_first`` in a hundred of these with the suffix first. Columns named by
    ``without`` don't come out again (the text may be one)."""
    added = T.StructType.fromDDL(FIELDS)
    kept = [f for f in docs.schema.fields if f.name not in added.names and f.name not in without]
    names = [f.name for f in kept]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("_text"), F.col(doc_id).cast("string").alias("_id"))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for at, texts in C.runs(batch["_text"]):  # a run bounds what is held at once
                part = batch.slice(at, len(texts))
                rows = [rearranged(t.decode(), draws(seed, i), rate, suffix_first) for t, i in zip(texts, part["_id"].to_pylist(), strict=True)]
                new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, *new], names=[*names, *added.names])

    return source.mapInArrow(batches, T.StructType([*kept, *added.fields]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no piece holds a mark, and none can begin inside one, so marks cut it."""
    piece = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output)
