"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius, and their components.

1. A fingerprint's bit is 1 if it is set in over half of the hashes of a text's shingles, repeats counted. Equal
   fingerprints are one from here on, so copies cost one row.
2. Fingerprints that may be close meet in tables keyed by some of their bits: any two within the radius agree in all key
   bits of one of the ``exact_tables``, whatever the data. Texts that are to be similar (``deduplicated``) meet at their
   first shingles in an order of all shingles instead, which no similar pair escapes and which costs the same share of a
   text however many texts there are.
3. The members of a key are compared bit-sliced (``bitsliced``), a key of more than ``CHUNK`` members in pairs of chunks
   (``blocks``), so that no group grows with the data and no link is lost.
4. A group hands on a spanning forest of its links; components come from contraction.

Words are runs of non-space characters, A-Z lower-cased; a text of fewer words than a shingle is one shingle; a text
without words (null, empty) has the fingerprint zero, which links like any other. Rows may repeat. Columns of the input
that carry an output name are replaced, all others stay. A null id counts for no component; a component of null ids
only has a null name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import bitsliced as B
from tarnflow.llm import blocks
from tarnflow.llm import common as C
from tarnflow.operators.components import connected_components

SEED = 42
#: Members of a key that are compared as one block.
CHUNK = 2048
#: Groups of up to this many members are compared together, pair by pair.
_SMALL = 48
#: Texts whose shingles leave Python together.
_ROWS = 500
_NO_LINKS = pa.RecordBatch.from_pylist([], pa.schema([("src", pa.binary()), ("dst", pa.binary())]))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of a text, space-joined, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 x ``words`` bits, big-endian; the bits beyond the first 64 come from further mixes of each hash."""
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    columns = np.stack([hashes if k == 0 else C.mix(hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) for k in range(words)], axis=1).astype(">u8")
    total = np.zeros(64 * words, np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(columns[at : at + 255 * 64].view(np.uint8), axis=1).view(np.uint64)
        # Bytes count to 255 at most: that many rows are added up eight counters a word.
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64 * words).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, size: int, words: int = 1, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The documents with the fingerprint as bytes, without the text."""

    def new(batch: pa.RecordBatch) -> list[pa.Array]:
        out = [fingerprint(shingle_hashes((t.as_py() or "").encode(), size), words) for t in batch[text]]
        return [pa.array(out, pa.binary())]

    return C.mapped(docs, f"{name} binary", new, (text,))


def exact_tables(bits: int, radius: int, more: int = 2) -> list[np.ndarray]:
    """Bit positions of the keys: of radius + ``more`` blocks at most ``radius`` hold a difference, so ``more`` agree."""
    blocks = np.array_split(np.arange(bits), radius + more)
    return [np.concatenate([blocks[i] for i in chosen]) for chosen in combinations(range(radius + more), more)]


def _as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The first ``width`` bytes of each row; rows are equally long."""
    rows = np.frombuffer(b"".join(x.as_py() for x in column), np.uint8)
    return np.ascontiguousarray(rows.reshape(len(column), -1 if len(column) else width)[:, :width])


def keyed(prints: DataFrame, tables: list[np.ndarray], width: int) -> DataFrame:
    """(t, key, print): each fingerprint once for each table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(_as_matrix(batch["print"], width), axis=1).astype(np.int64)
            for t, at in enumerate(tables):
                key = bits[:, at] @ (np.int64(1) << np.arange(len(at), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), batch["print"]], names=["t", "key", "print"])

    return prints.mapInArrow(rows, "t int, key long, print binary")


def forest(prints: np.ndarray, group: np.ndarray, crossed: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the same group within the radius, as (row, smaller row of its class)."""
    labels = np.arange(len(group))
    for step, i in blocks.near_rows(group, crossed, _SMALL):
        hit = i[B.close_in_pairs(prints[i], prints[i + step], radius)]
        B.merge(labels, hit, hit + step)
    for left, right in blocks.large_groups(group, crossed, _SMALL):
        for i, j in B.close_across(prints[left], prints[right], radius):
            B.merge(labels, left[i], right[j])
    moved = np.flatnonzero(labels != np.arange(len(group)))
    return moved, labels[moved]


def links(rows: DataFrame, width: int, radius: int, keys: list[str] | None = None) -> DataFrame:
    """(src, dst): a spanning forest of the links within each group."""

    def flush(table: pa.Table, group: np.ndarray, crossed: np.ndarray) -> pa.RecordBatch:
        i, j = forest(_as_matrix(table["print"], width), group, crossed, radius)
        return pa.table({"src": table["print"].take(pa.array(i)), "dst": table["print"].take(pa.array(j))}).combine_chunks().to_batches(len(i) or None)[0] if len(i) else _NO_LINKS

    return blocks.compared(rows, keys or ["t", "key"], "print", "src binary, dst binary", flush)


def classes(prints: DataFrame, tables: list[np.ndarray], width: int, radius: int) -> DataFrame:
    """(node, component) of the distinct fingerprints ``print`` that have a link to another."""
    rows = blocks.dealt(keyed(prints, tables, width), ["t", "key"], "print", CHUNK)
    return connected_components(links(rows, width, radius))


def near_duplicates(docs: DataFrame, size: int, words: int, radius: int, tables: list[np.ndarray] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; a component's id is the smallest doc_id in it."""
    found = C.checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), size, words, "_text"))
    return components_of(found, words, radius, tables)


def components_of(found: DataFrame, words: int, radius: int, tables: list[np.ndarray] | None = None) -> DataFrame:
    """Adds ``component_id`` to rows (doc_id, fingerprint)."""
    distinct = C.checkpointed(found.groupBy(F.col("fingerprint").alias("print")).agg(F.min("doc_id").alias("least")))
    cc = classes(distinct.select("print"), tables or exact_tables(64 * words, radius), 8 * words, radius)
    named = distinct.join(cc.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select(F.col("print").alias("fingerprint"), "component_id")
    return found.join(named, "fingerprint").select(*found.columns, "component_id")


def _bounds(similarity: float, n: int) -> int:
    """How many shingles of a set of n any set of that similarity shares with it, at least."""
    return math.ceil(similarity * n - 1e-9)


class Order:
    """An order of all shingles: those that are known to be common last, the others by their hash."""

    def __init__(self, common: dict[int, int]) -> None:
        self.hashes = np.array(sorted(common), np.uint64)
        self.times = np.array([common[h] for h in self.hashes.tolist()], np.int64)

    def first(self, own: np.ndarray, similarity: float) -> np.ndarray:
        """Of a set of shingles (ascending), so many of the first that any similar set holds one of them among its own first."""
        n = len(own)
        most = n - _bounds(similarity, n) + 1 if n else 0
        if not len(self.hashes):
            return own[:most]
        place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        often = np.where(self.hashes[place] == own, self.times[place], 0)
        return own[np.argsort(often, kind="stable")][:most]


def prefixed(sets: DataFrame, similarity: float, common: dict[int, int]) -> DataFrame:
    """(shingle, print, shingles): each set once for each of its first shingles, the rare ones first (``common``: how often
    those occur that aren't rare; it orders, nothing is left out). Two similar sets share one of these in any order."""
    order = Order(common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                keys = [order.first(np.frombuffer(held, np.uint64), similarity).view(np.int64) for held in part["shingles"].to_pylist()]
                take = pa.array(np.repeat(np.arange(len(keys)), list(map(len, keys))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), part["print"].take(take), part["shingles"].take(take)], names=["shingle", "print", "shingles"])

    return sets.mapInArrow(rows, "shingle long, print binary, shingles binary")


def _each(sets: DataFrame, column: str, name: str = "print") -> DataFrame:
    """(shingle, print): the shingles in a column of bytes, a row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):  # a row becomes many
                part = batch.slice(at, _ROWS)
                held = part[column].to_pylist()
                take = pa.array(np.repeat(np.arange(len(held)), [len(x) // 8 for x in held]))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(held), np.int64)), part[name].take(take)], names=["shingle", name])

    return sets.select(column, name).mapInArrow(rows, f"shingle long, {name} binary")


def _most(counted: DataFrame, least: int) -> dict[int, int]:
    """The most frequent shingles of (shingle, count), as far as a broadcast of bounded size goes."""
    while counted.filter(F.col("count") > least).count() > MOST_COMMON:
        least *= 2
    return {r["shingle"] % 2**64: r["count"] for r in counted.filter(F.col("count") > least).collect()}


def _common(sets: DataFrame) -> dict[int, int]:
    """How many sets hold a shingle, for the most frequent ones."""
    return _most(blocks.large(_each(sets, "shingles").select("shingle"), ["shingle"], 16), 16)


def _alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both sides whose sets are similar, by products of incidence matrices."""
    sizes = [np.fromiter((len(sets[r]) for r in side), np.int64, len(side)) for side in (left, right)]
    held = [np.concatenate([sets[r] for r in side]) for side in (left, right)]
    known = np.intersect1d(*held)
    both = np.zeros((len(left), len(right)), np.float32)
    at = [np.searchsorted(known, h) for h in held]
    real = [np.append(known, 0)[a] == h if len(known) else np.zeros(len(h), bool) for a, h in zip(at, held, strict=True)]
    row = [np.repeat(np.arange(len(n)), n) for n in sizes]
    for begin in range(0, len(known), 4096):
        parts = []
        for a, ok, r, n in zip(at, real, row, sizes, strict=True):
            hit = ok & (a >= begin) & (a < begin + 4096)
            m = np.zeros((len(n), min(4096, len(known) - begin)), np.float32)
            m[r[hit], a[hit] - begin] = 1
            parts.append(m)
        both += parts[0] @ parts[1].T
    return np.nonzero(both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both))


def _similar(sets: list[np.ndarray], i: int, j: int, similarity: float) -> bool:
    a, b = sets[i], sets[j]
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _add_similar(labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> None:
    """Joins the classes of the pairs that are similar; a pair that is in one class by then isn't looked at."""
    apart = np.flatnonzero(labels[left] != labels[right])
    for i, j in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
        if labels[i] != labels[j] and _similar(sets, i, j, similarity):
            B.merge(labels, np.array([i]), np.array([j]))


def exact_forest(sets: list[np.ndarray], group: np.ndarray, crossed: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, with links wherever the sets are similar."""
    labels = np.arange(len(group))
    for step, i in blocks.near_rows(group, crossed, _SMALL):
        _add_similar(labels, sets, i, i + step, similarity)
    for left, right in blocks.large_groups(group, crossed, _SMALL):
        i, j = _alike(sets, left, right, similarity)
        B.merge(labels, left[i], right[j])
    moved = np.flatnonzero(labels != np.arange(len(group)))
    return moved, labels[moved]


def similar_forest(prints: np.ndarray, sets: list[np.ndarray], group: np.ndarray, crossed: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, with links only where the Jaccard similarity of the shingle sets is reached."""
    labels = np.arange(len(group))
    for step, i in blocks.near_rows(group, crossed, _SMALL):
        hit = i[B.close_in_pairs(prints[i], prints[i + step], radius)]
        _add_similar(labels, sets, hit, hit + step, similarity)
    for left, right in blocks.large_groups(group, crossed, _SMALL):
        for i, j in B.close_across(prints[left], prints[right], radius):
            _add_similar(labels, sets, left[i], right[j], similarity)
    moved = np.flatnonzero(labels != np.arange(len(group)))
    return moved, labels[moved]


#: For a Jaccard similarity of 0.8 or more: fingerprints of 128 bits within 40. A bit of two texts at 0.8 differs with
#: probability 0.15: they are apart in 19.5 bits (deviation 4.1), and farther than the radius in up to three of a million cases.
#: Fingerprints are those of the distinct shingles, as the similarity is one of sets.
STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_WORDS, STAGE_RADIUS = 5, 0.8, 2, 40
#: Shingle sets that are compared as one block.
STAGE_CHUNK = 256
#: Sets of up to this many shingles are too few votes for a fingerprint: they are compared as they are, with all that may
#: be similar to one of them.
EXACT_SHINGLES, EXACT_CHUNK = 32, 1024
#: Sets that a shingle brings together before it is put last; shingles that are, at most; how often they are looked for.
HOT, MOST_COMMON, ROUNDS = 8192, 20_000, 4
#: Texts, counted first, up to which what names them is broadcast.
MOST_BROADCAST = 100_000


def _small(rows: DataFrame) -> DataFrame:
    """Rows that name texts, broadcast if counting them shows that they are few."""
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rows


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; columns as they were.

    Documents link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Two such sets share one
    of their first shingles, a fifth of each, in any order of all shingles; the members of such a shingle are compared by
    their fingerprints, which gives loose classes, and within these the shingle sets are compared wherever fingerprints are
    close. The order is that of the hashes; shingles that bring more than ``HOT`` sets together are put last, which changes
    what comes first, so this is done again until none is new (or ``ROUNDS`` times). Shingles of more than ``CHUNK`` sets are
    dealt into chunks, by their count or a number that is not below it.
    Small sets are compared as they are. Equal sets are one text here: a ``print`` is the fingerprint followed by a hash of
    128 bits of the whole set, so equal fingerprints are candidates like any others. Texts without words are one text. Of
    rows of the same id and text one stays; a document without an id comes after all others."""
    width = 8 * STAGE_WORDS
    names = docs.columns
    inner = docs.select(*(F.col(c).alias(f"_in_{i}") for i, c in enumerate(names)), F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"))
    largest = int(EXACT_SHINGLES / STAGE_SIMILARITY + 1e-9)

    def print_of(own: np.ndarray) -> bytes:
        return fingerprint(own, STAGE_WORDS) + xxhash.xxh3_128_digest(own.tobytes())

    def first_of(own: np.ndarray, order: Order) -> bytes:
        return order.first(own, STAGE_SIMILARITY).tobytes() if len(own) > EXACT_SHINGLES else b""

    def prints(batch: pa.RecordBatch) -> list[pa.Array]:
        """The print, the set itself if it is small, its first shingles if it isn't."""
        rows = []
        for t in batch["_text"]:
            own = np.unique(shingle_hashes((t.as_py() or "").encode(), STAGE_SHINGLE))
            rows.append((print_of(own), own.tobytes() if len(own) <= largest else None, first_of(own, Order({}))))
        return [pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]

    found = C.checkpointed(C.mapped(inner.select("_id", "_h", "_text"), "print binary, small binary, first binary", prints, ("_text",)))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h")).alias("least")
    distinct = C.checkpointed(found.groupBy("print").agg(least, F.first("small").alias("small"), F.first("first").alias("first")))
    found = found.select("_id", "_h", "print")
    same = F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_h") == F.col("_mh"))
    of_least = [F.col("least._id").alias("_mid"), F.col("least._h").alias("_mh")]

    def again(met: DataFrame, fresh: set[int], common: dict[int, int]) -> tuple[DataFrame, DataFrame]:
        """The texts without one of ``fresh`` among their first shingles, as they are, and the others with their first in the new order."""
        hot, order = np.array(sorted(fresh), np.uint64), Order(common)
        holds = lambda batch: [pa.array([bool(np.isin(np.frombuffer(x, np.uint64), hot).any()) for x in batch["first"].to_pylist()], pa.bool_())]
        marked = C.mapped(met, "holds boolean", holds)
        hashes = C.checkpointed(marked.filter("holds").select("_h").distinct())

        def first(batch: pa.RecordBatch) -> list[pa.Array]:
            own = [np.unique(shingle_hashes((t.as_py() or "").encode(), STAGE_SHINGLE)) for t in batch["_text"]]
            return [pa.array([print_of(x) for x in own], pa.binary()), pa.array([first_of(x, order) for x in own], pa.binary())]

        texts = inner.select("_h", "_text").join(_small(hashes), "_h", "left_semi")
        new = C.checkpointed(C.mapped(texts, "print binary, first binary", first, ("_text",)).dropDuplicates(["print"]))
        return marked.filter("not holds").drop("holds"), new

    # How many sets a large shingle brings together; of one that more sets come to, at most that many.
    met, common = distinct.filter("first <> x''").select("print", F.col("least._h").alias("_h"), "first"), {}
    counted = blocks.large(_each(met, "first").select("shingle"), ["shingle"], CHUNK)
    for _ in range(ROUNDS):
        fresh = {h: n for h, n in _most(counted, HOT).items() if h not in common}
        if not fresh:
            break
        common |= fresh
        rest, new = again(met, set(fresh), common)
        met = C.checkpointed(rest.unionByName(new))
        added = blocks.large(_each(new, "first").select("shingle"), ["shingle"], CHUNK).withColumn("count", F.col("count") + CHUNK)
        counted = C.checkpointed(counted.unionByName(added).groupBy("shingle").agg(F.sum("count").alias("count")))
    keyed_ = _each(met, "first")
    loose = connected_components(links(blocks.dealt(keyed_, ["shingle"], "print", CHUNK, counted), width, STAGE_RADIUS, ["shingle"]))
    members = loose.join(distinct.select(F.col("print").alias("node"), "least"), "node").select(F.col("node").alias("print"), F.xxhash64("component").alias("component"), *of_least)
    texts = inner.select("_id", "_h", "_text").join(_small(C.checkpointed(members)), same).select("print", "component", "_text").dropDuplicates(["print"])

    def shingles(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([np.unique(shingle_hashes((t.as_py() or "").encode(), STAGE_SHINGLE)).tobytes() for t in batch["_text"]], pa.binary())]

    sets = C.checkpointed(C.mapped(texts, "shingles binary", shingles, ("_text",)))

    def flush(table: pa.Table, group: np.ndarray, crossed: np.ndarray) -> pa.RecordBatch:
        held = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        i, j = similar_forest(_as_matrix(table["print"], width), held, group, crossed, STAGE_RADIUS, STAGE_SIMILARITY)
        pairs = [table["print"].take(pa.array(rows)).to_pylist() for rows in (i, j)]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.binary()) for p in pairs], names=["src", "dst"])

    linked = blocks.compared(blocks.dealt(sets, ["component"], "print", STAGE_CHUNK), ["component"], "print", "src binary, dst binary", flush)

    few = distinct.filter("small is not null").select("print", F.col("small").alias("shingles"))

    def flush_few(table: pa.Table, group: np.ndarray, crossed: np.ndarray) -> pa.RecordBatch:
        held = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        i, j = exact_forest(held, group, crossed, STAGE_SIMILARITY)
        pairs = [table["print"].take(pa.array(rows)).to_pylist() for rows in (i, j)]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.binary()) for p in pairs], names=["src", "dst"])

    met = prefixed(few, STAGE_SIMILARITY, _common(few))
    linked = linked.union(blocks.compared(blocks.dealt(met, ["shingle"], "print", EXACT_CHUNK), ["shingle"], "print", "src binary, dst binary", flush_few))
    cc = connected_components(linked)
    named = distinct.select("print", "least").join(cc.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    kept = named.groupBy("component").agg(F.min("least").alias("least")).select(*of_least)
    dropped = C.checkpointed(found.select("_id", "_h").distinct().join(kept, same, "left_anti").select(F.col("_id").alias("_mid"), F.col("_h").alias("_mh")))
    out = inner.drop("_text").join(_small(dropped), same, "left_anti")
    repeated = found.groupBy("_id", "_h").count().filter("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["_id", "_h"])
    return out.select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)))
