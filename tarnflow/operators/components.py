"""Connected components of an edge table by contraction.

Each round hooks every node to its smallest neighbour, if that is smaller, follows the hooks to their ends by doubling, and
replaces the ends of all edges by these roots; edges inside a tree vanish. Every node with an edge to another one ends
in a tree of two nodes at least, so a round halves the nodes that are left, and in practice a few rounds do. A node's
neighbours are only ever reduced to a minimum, so a hub costs a partial aggregate and joins that Spark may split; the
tables of a round are checkpointed, without the size that their plans are thought to have, and never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.session import round_of

#: Rows of a map (node, root), counted first, up to which it is broadcast.
MOST_BROADCAST = 20_000


def _with(df: DataFrame, node: str, hooks: DataFrame, few: bool, root: str) -> DataFrame:
    """Adds the root of a node, the node itself where there is no hook."""
    h = hooks.select(F.col("u").alias("_u"), F.col("root").alias("_r"))
    joined = df.join(F.broadcast(h) if few else h, F.col(node) == F.col("_u"), "left")
    return joined.withColumn(root, F.coalesce("_r", node)).drop("_u", "_r")


def _least(edges: DataFrame) -> DataFrame:
    """(u, root, n): each node's smallest neighbour and the number of its links."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("root"), F.count(F.lit(1)).alias("n"))


def _roots(least: DataFrame) -> tuple[DataFrame, bool]:
    """(u, root) of every node that hooks to a smaller one, and whether there are few."""
    hooks = round_of(least.filter("root < u").select("u", "root"))
    few = hooks.count() <= MOST_BROADCAST
    while True:
        on = _with(hooks.withColumnRenamed("root", "at"), "at", hooks, few, "root")
        on = round_of(on)
        moved = not on.filter("at <> root").isEmpty()
        hooks = on.select("u", "root")
        if not moved:
            return hooks, few


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars: every node with the smallest one that the batch's edges join it with."""
    for batch in batches:
        ids, at = np.unique(np.concatenate([batch[c].to_numpy() for c in ("u", "v")]), return_inverse=True)
        u, v = at[: batch.num_rows], at[batch.num_rows :]
        root = np.arange(len(ids))
        while (root[u] != root[v]).any():
            np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
            while (root[root] != root).any():
                root = root[root]
        moved = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", near: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge to another one; a component is named by its smallest node.

    Direction, repeats and order of the edges don't matter; loops and edges with a null end are ignored. Nodes that hang on one smaller
    node join and name nothing: where they are many, their edges take no part in the rounds.

    ``near``: nodes are longs and most edges join numbers that aren't far apart, as in rasters. Edges, best checkpointed, are
    then sorted, and each batch of them becomes stars, so all but the nodes between batches hang on one node. Other numbers give
    the same, for a sort more."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter(F.col("u") != F.col("v"))
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if near:
        e = e.orderBy("v", "u").mapInArrow(_stars, "u long, v long")
    e = round_of(e.distinct())
    least = round_of(_least(e))
    hanging = (F.col("n") == 1) & (F.col("root") < F.col("u"))
    nodes = least.select(F.col("u").alias("node"), F.when(hanging, F.col("root")).otherwise(F.col("u")).alias("component"))
    ends, hung = least.agg(F.sum("n"), F.count_if(hanging)).first()
    if hung * 4 > (ends or 0):  # more than half of the edges
        e = round_of(e.join(least.filter(hanging).select(F.col("u").alias("_h")), F.col("u") == F.col("_h"), "left_anti"))
        least = _least(e)
    names: DataFrame | None = None
    while not e.isEmpty():
        hooks, few = _roots(least)
        names = hooks if names is None else round_of(_with(names, "root", hooks, few, "_c").select("u", F.col("_c").alias("root")).union(hooks))
        joined = _with(_with(e, "u", hooks, few, "a"), "v", hooks, few, "b").filter("a <> b")
        e = round_of(joined.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        least = _least(e)
    if names is None:
        return nodes
    return _with(nodes, "component", names, names.count() <= MOST_BROADCAST, "_c").select("node", F.col("_c").alias("component"))
