"""Benchmark decontamination: a broadcast hash set of the items' word windows, scanned by every document.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Hash hits are verified on the words
themselves. Null and empty texts have no words; an item without words matches nothing; items with equal ids count once,
and an item without an id marks words but is not named. Rows may repeat. Columns of the documents that carry an output
name are replaced, all others stay. The documents are scanned once for each part of the benchmark of at most
``PART_BYTES`` of text (longer items are cut in pieces that overlap), so that what is broadcast stays bounded whatever the benchmark's
size; of the documents nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import common as C
from tarnflow.operators.order import running

WINDOW = 10
#: Text of the benchmark held by one broadcast at most, and by a piece of an item: parts begin where pieces have filled the rest.
PART_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
FIELDS = "n_words long, hit_words array<int>, items array<string>"


class Windows:
    """Windows of a length: their hashes in order, with repeats, and of each where its words are written and whose they are."""

    def __init__(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> None:
        order = np.lexsort((begin, hashes))
        self.hashes, self.begin, self.end, self.item = hashes[order], begin[order].astype(np.int32), end[order].astype(np.int32), item[order].astype(np.int32)


class Index:
    """The windows of some items: their words written once, behind one another, and by length the windows as places there. A window
    takes 20 bytes, so the whole a few times the items' text."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.ids = [item_id for item_id, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        written, at = [], 0
        for k, (_, text) in enumerate(items):
            w = C.Words([text], C.WORD, lower=True)
            if n := min(window, len(w.start)):
                body = words_of(w, 0, len(w.start))
                length = w.end - w.start
                ends = at + np.cumsum(length + 1) - 1
                begins = ends - length
                hashes = C.windows(w.hashes(), n)
                found[n].append((hashes, begins[: len(hashes)], ends[n - 1 :], np.full(len(hashes), k)))
                written.append(body)
                at += len(body) + 1
        self.words = b" ".join(written)
        self.by_length = {n: Windows(*(np.concatenate(x) for x in zip(*parts, strict=True))) for n, parts in found.items()}

    def owners(self, known: Windows, at: int, words: bytes) -> set[str] | None:
        """The items of a window, from its first place among the hashes; None if no item has just these words."""
        out: set[str] | None = None
        end = int(np.searchsorted(known.hashes, known.hashes[at], "right"))
        for k in range(at, end):
            if self.words[known.begin[k] : known.end[k]] == words:
                out = (out or set()) | {self.ids[known.item[k]]}
        return None if out is None else out - {None}


def words_of(w: C.Words, at: int, n: int) -> bytes:
    return b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(at, at + n))


def scan_run(texts: list[bytes], index: Index) -> list[tuple[int, np.ndarray, set[str]]]:
    """Of each text: number of words, positions of the hit words, items."""
    w = C.Words(texts, C.WORD, lower=True)
    hashes = w.hashes()
    ends = np.zeros(len(hashes) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for n, known in index.by_length.items():
        found = C.windows(hashes, n)
        if not len(found):
            continue
        at = np.searchsorted(known.hashes, found)
        hit = np.flatnonzero((known.hashes[np.minimum(at, len(known.hashes) - 1)] == found) & (w.doc[: len(found)] == w.doc[n - 1 :]))
        owners: dict[bytes, set[str] | None] = {}
        for p in hit.tolist():
            if (words := words_of(w, p, n)) not in owners:
                owners[words] = index.owners(known, int(at[p]), words)
            if (who := owners[words]) is not None:
                ends[p] += 1
                ends[p + n] -= 1
                items[int(w.doc[p])] |= who
    marked = np.cumsum(ends[:-1]) > 0
    return [(int(b - a), np.flatnonzero(marked[a:b]), items.get(k, set())) for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True))]


def _pieces(batch: pa.RecordBatch, window: int) -> Iterator[tuple[str | None, str]]:
    """Items of more than ``PIECE_BYTES`` as pieces that share ``window`` - 1 words, so that each window is in one at least."""
    for item_id, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
        raw = text.encode()
        if len(raw) <= PIECE_BYTES:
            yield item_id, text
            continue
        w = C.Words([raw], C.WORD, lower=True)
        first, count = 0, len(w.start)
        while first < count:
            last = int(np.searchsorted(w.end, w.start[first] + PIECE_BYTES, "right"))
            last = min(count, max(last, first + window))
            yield item_id, raw[w.start[first] : w.end[last - 1]].decode()
            if last == count:
                break
            first = last - window + 1


def _parts(benchmark: DataFrame, window: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items' pieces in parts of at most ``PART_BYTES`` + ``PIECE_BYTES`` of text: in order, cut where their sizes have added up.
    Each pull to the driver holds one part. A window of more than ``PART_BYTES`` is refused: it can't be broadcast in bounds."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in _pieces(batch, window):
                yield pa.RecordBatch.from_arrays([pa.array([item_id], pa.string()), pa.array([text], pa.string())], names=["item_id", "text"])

    sized = items.mapInArrow(cut, "item_id string, text string").withColumn("size", F.octet_length("text").cast("long"))
    sized = C.checkpointed(running(sized, ["item_id", "text"], F.col("size"), "upto"))
    largest, total = sized.agg(F.max("size"), F.max("upto")).first()
    if (largest or 0) > PART_BYTES:
        raise ValueError(f"a window of {largest} bytes: more than a part of the benchmark may hold")
    room = max(PART_BYTES - (largest or 0), PIECE_BYTES)  # what a part takes before its last piece
    for k in range((total or 0) // room + 1):
        part = sized.filter(((F.col("upto") - F.col("size")) >= k * room) & ((F.col("upto") - F.col("size")) < (k + 1) * room))
        yield [(r.item_id, r.text.encode()) for r in part.select("item_id", "text").toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``hit_words`` (positions of words inside an occurring window) and ``items`` (sorted ids)."""
    out = docs
    for k, items in enumerate(_parts(benchmark, window)):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, window))

        def new(batch: pa.RecordBatch, shared: Any = shared, first: bool = k == 0) -> list[pa.Array]:
            n_words, hits, items = [], [], []
            for _, texts in C.runs(batch[text]):
                for n, hit, who in scan_run(texts, shared.value):
                    n_words.append(n)
                    hits.append(hit)
                    items.append(who)
            if not first:
                hits = [np.union1d(h, old) for h, old in zip(hits, batch["hit_words"].to_pylist(), strict=True)]
                items = [who | set(old) for who, old in zip(items, batch["items"].to_pylist(), strict=True)]
            return [pa.array(n_words, pa.int64()), pa.array([h.astype(np.int32) for h in hits], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

        out = C.mapped(C.checkpointed(out) if k else out, FIELDS, new)
    return out


def _renamed(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The documents with columns that can't clash with ours, and the name of the text among them."""
    return docs.select(*(F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns))), f"_in_{docs.columns.index(text)}"


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without a hit word; columns as they were."""
    inner, body = _renamed(docs, text)
    found = scan(inner, benchmark, window, body)
    return found.filter(F.size("hit_words") == 0).select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)))


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents with each run of hit words cut from the text, up to the start of the next word; columns as they were."""
    inner, body = _renamed(docs, text)

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for value, hits in zip(batch[body], batch["hit_words"], strict=True):
            value, hits = value.as_py(), hits.as_py()
            if hits:
                raw = value.encode()
                w = C.Words([raw], C.WORD, lower=True)
                starts = [*w.start.tolist(), len(raw)]
                gone, kept, at = set(hits), [], 0
                for i in range(len(w.start)):
                    if i in gone:
                        kept.append(raw[at : starts[i]])
                        at = starts[i + 1]
                value = b"".join([*kept, raw[at:]]).decode()
            out.append(value)
        return [pa.array(out, pa.string())]

    found = C.mapped(scan(inner, benchmark, window, body), "_cut string", cut)
    return found.select(*((F.col("_cut") if c == text else F.col(f"_in_{i}")).alias(c) for i, c in enumerate(docs.columns)))
