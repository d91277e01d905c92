"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors of a label are compared; equal ones are one row with a count from here on. In each of ``TABLES`` tables a vector's
key is the signs of its products with ``BITS`` random hyperplanes: two vectors at cosine 0.98 share a key of 14 bits with
probability 0.40 in a table and 0.9997 in any of 16. Members of a key are compared by their exact cosine in double
precision, large keys in pairs of chunks (``blocks``). A pair counts in the first table where it shares a key, so each link
counts once and no pair leaves a task: what does is a node's number of links and a spanning forest.

A vector that is null, empty, zero or holds a null or non-finite component, or has no label, links with nothing; vectors of
different lengths don't link. Rows may repeat, each is a vector of its own. A null id names no component and is never kept.
Columns of the input that carry an output name are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import bitsliced as B
from tarnflow.llm import blocks
from tarnflow.llm import common as C
from tarnflow.operators.components import connected_components

THRESHOLD = 0.98
BITS, TABLES = 14, 16
SEED = 31
CHUNK = 1024
_SMALL = 32


def hyperplanes(dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).normal(size=(dimensions, BITS * TABLES))


def keyed(nodes: DataFrame) -> DataFrame:
    """Each node once for each table: its group, key, copies, vector (doubles as bytes) and its keys in all tables."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch["vector"]
            flat = np.asarray(vectors.values.slice(vectors.offsets[0].as_py(), vectors.offsets[-1].as_py() - vectors.offsets[0].as_py()).cast(pa.float64())) if len(vectors) else np.zeros(0)
            lengths = np.diff(np.asarray(vectors.offsets))
            at = np.concatenate(([0], np.cumsum(lengths)))
            for n in np.unique(lengths):
                where = np.flatnonzero(lengths == n)
                x = flat[at[where][:, None] + np.arange(n)]
                if n not in planes:
                    planes[n] = hyperplanes(int(n))
                signs = (x @ planes[n] > 0).reshape(len(where), TABLES, BITS)
                keys = (signs @ (1 << np.arange(BITS))).astype(np.int32)
                taken = batch.take(pa.array(where))
                packed = pa.array([v.tobytes() for v in x], pa.binary())
                sig = pa.array([k.tobytes() for k in keys], pa.binary())
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([taken["grp"], pa.array(np.full(len(where), t, np.int32)), pa.array(keys[:, t]), taken["node"], taken["copies"], packed, sig], names=["grp", "t", "key", "node", "copies", "vector", "keys"])

    return nodes.select("grp", "node", "copies", "vector").mapInArrow(rows, "grp long, t int, key int, node binary, copies long, vector binary, keys binary")


def linked(x: np.ndarray, keys: np.ndarray, table: np.ndarray, copies: np.ndarray, group: np.ndarray, crossed: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(labels, links): the smallest row of each row's class, and the copies each row links with here for the first time."""
    labels, links = np.arange(len(x)), np.zeros(len(x), np.int64)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))

    def add(i: np.ndarray, j: np.ndarray) -> None:
        B.merge(labels, i, j)
        before = np.arange(TABLES)[None, :] < table[i][:, None]
        first = ~((keys[i] == keys[j]) & before).any(axis=1)
        np.add.at(links, i[first], copies[j[first]])
        np.add.at(links, j[first], copies[i[first]])

    for step, i in blocks.near_rows(group, crossed, _SMALL):
        for part in np.array_split(i, len(i) // 8192 + 1):
            cosine = np.einsum("ij,ij->i", x[part], x[part + step]) / (norms[part] * norms[part + step])
            hit = part[cosine >= threshold]
            add(hit, hit + step)
    for left, right in blocks.large_groups(group, crossed, _SMALL):
        for rows in np.array_split(left, len(left) // 128 + 1):
            cosine = (x[rows] @ x[right].T) / (norms[rows][:, None] * norms[right][None, :])
            i, j = np.nonzero(cosine >= threshold)
            i, j = rows[i], right[j]
            if left is right:
                i, j = i[i < j], j[i < j]
            add(i, j)
    return labels, links


def compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, other, links): links of a node found here, and a smaller member of its class, if any."""

    def flush(table: pa.Table, group: np.ndarray, crossed: np.ndarray) -> pa.RecordBatch:
        alone = np.diff(group, prepend=-1).astype(bool) & np.diff(group, append=group[-1] + 1).astype(bool)
        rows = np.flatnonzero(~alone)
        out: list[tuple[bytes, bytes, int]] = []
        table, group, crossed = table.take(pa.array(rows)), group[rows], crossed[rows]
        vectors = table["vector"].to_pylist()
        widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
        for width in np.unique(widths):  # a group holds one width: it is part of grp
            at = np.flatnonzero(widths == width)
            x = np.frombuffer(b"".join(vectors[i] for i in at), np.float64).reshape(len(at), -1)
            keys = np.frombuffer(b"".join(table["keys"].take(pa.array(at)).to_pylist()), np.int32).reshape(len(at), TABLES)
            labels, links = linked(x, keys, np.asarray(table["t"])[at], np.asarray(table["copies"])[at], group[at], crossed[at], threshold)
            nodes = table["node"].take(pa.array(at)).to_pylist()
            out += [(nodes[i], nodes[labels[i]], int(links[i])) for i in np.flatnonzero((labels != np.arange(len(at))) | (links > 0))]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64())], names=["node", "other", "links"])

    return blocks.compared(rows, ["grp", "t", "key"], "node", "node binary, other binary, links long", flush)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    v = F.col("vector")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    # Equal vectors of a label share a node: a digest of both.
    digest = F.unhex(F.md5(F.concat_ws(",", F.col("label"), F.transform(v, lambda x: (x + 0.0).cast("string")))))
    rows = C.checkpointed(rows.withColumn("node", F.when(valid, digest)).withColumn("vector", F.when(valid, v)))
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"), F.first(F.xxhash64("label", F.size("vector"))).alias("grp"))
    nodes = C.checkpointed(nodes)
    found = C.checkpointed(compare(blocks.dealt(keyed(nodes), ["grp", "t", "key"], "node", CHUNK), threshold))
    cc = connected_components(found, "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies", "least").join(links, "node", "left").join(cc, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
