"""Multi-level cell keys (an octree as tables of level and key): parents, children, leaves, links and look-ups by equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.operators.graph import dilated

AXES = ("i", "j", "k")


def with_coords(keys: DataFrame, dims: Sequence[int]) -> DataFrame:
    return keys.withColumns(dict(zip(AXES, G.coords_of(F.col("key"), dims), strict=True)))


def parents(keys: DataFrame, dims: Sequence[int]) -> DataFrame:
    """Distinct parents (key at the next level) of keys at a level of ``dims`` cells."""
    up = [F.shiftright(c, 1) for c in G.coords_of(F.col("key"), dims)]
    return keys.select(G.flat_key(up, G.dims_at(dims, 1)).alias("key")).distinct()


def children(keys: DataFrame, dims: Sequence[int]) -> DataFrame:
    """The eight children of each key, at the finer level of ``dims`` cells, inside the box."""
    coarse = G.dims_at(dims, 1)
    df = with_coords(keys, coarse).select(*AXES, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("o"))
    index = [F.shiftleft(F.col(a), 1) + F.shiftright(F.col("o"), s).bitwiseAND(1) for a, s in zip(AXES, (2, 1, 0), strict=True)]
    inside = F.lit(True)
    for c, n in zip(index, dims, strict=True):
        inside = inside & (c < n)
    return df.filter(inside).select(G.flat_key(index, dims).alias("key")).distinct()


def grown(keys: DataFrame, dims: Sequence[int], radius: int) -> DataFrame:
    out = dilated(with_coords(keys, dims).select(*AXES), AXES, dims, radius)
    return out.select(G.flat_key([F.col(a) for a in AXES], dims).alias("key"))


def graded(closed: DataFrame, dims: Sequence[int], levels: int, margin: int = 1) -> DataFrame:
    """(level, key) of an octree's leaves: closed cells stay at level 0 and have no leaf; around them cells are fine, and
    neighbouring leaves differ by one level at most. A level's refined cells are the parents of the dilated refined cells
    below; leaves are the children of refined cells that are neither refined nor closed themselves."""
    refined = [closed]
    for level in range(levels):
        refined.append(parents(grown(refined[-1], G.dims_at(dims, level), margin), G.dims_at(dims, level)))
    spark = closed.sparkSession
    top = G.dims_at(dims, levels)
    out = spark.range(top[0] * top[1] * top[2]).withColumnRenamed("id", "key").join(refined[levels], "key", "left_anti").select(F.lit(levels).alias("level"), "key")
    for level in range(levels - 1, -1, -1):
        cells = children(refined[level + 1], G.dims_at(dims, level))
        cells = cells.join(refined[level], "key", "left_anti")
        out = out.union(cells.select(F.lit(level).alias("level"), "key"))
    return out


def leaf_links(leaves: DataFrame, dims: Sequence[int], levels: int) -> DataFrame:
    """(level, key, other_level, other_key): face links of leaves, to the same level and to the next coarser one, once each.

    A leaf without a same-level neighbour across a face looks for the parent of that place: two equi-joins a level."""
    out = None
    for level in range(levels + 1):
        n = G.dims_at(dims, level)
        own = with_coords(leaves.filter(F.col("level") == level).select("key"), n)
        faces = []
        for axis, size in zip(AXES, n, strict=True):
            for step in (-1, 1):
                index = [F.col(a) + (step if a == axis else 0) for a in AXES]
                faces.append(F.when((F.col(axis) + step).between(0, size - 1), F.struct(*(c.alias(a) for c, a in zip(index, AXES, strict=True)))))
        there = own.select("key", F.explode(F.array_compact(F.array(*faces))).alias("p"))
        there = there.select("key", G.flat_key([F.col(f"p.{a}") for a in AXES], n).alias("other"), G.flat_key([F.shiftright(F.col(f"p.{a}"), 1) for a in AXES], G.dims_at(dims, level + 1)).alias("up"))
        same = leaves.filter(F.col("level") == level).select(F.col("key").alias("other"))
        equal = there.join(same, "other", "left_semi").filter("key < other").select(F.lit(level).alias("level"), "key", F.lit(level).alias("other_level"), F.col("other").alias("other_key"))
        out = equal if out is None else out.union(equal)
        if level < levels:
            coarse = leaves.filter(F.col("level") == level + 1).select(F.col("key").alias("up"))
            out = out.union(there.join(coarse, "up", "left_semi").select(F.lit(level), "key", F.lit(level + 1), F.col("up")))
    return out


def located(points: DataFrame, leaves: DataFrame, dims: Sequence[int], levels: int, dx: float, origin: Sequence[float]) -> DataFrame:
    """Adds (level, key) of the leaf that holds a point (x, y, z), null outside and in closed cells. Each cell that holds points is looked
    for once: a candidate a level, one equi-join over all levels."""
    index = [F.floor((F.col(p) - o) / dx).cast("int") for p, o in zip("xyz", origin, strict=True)]
    inside = F.lit(True)
    for c, n in zip(index, dims, strict=True):
        inside = inside & c.between(0, n - 1)
    # Points outside have numbers below 0, many of them, so that they don't meet in one task.
    placed = points.withColumn("_c", F.when(inside, G.flat_key(index, dims)).otherwise(-1 - F.pmod(F.xxhash64(*"xyz"), F.lit(1 << 20))))
    at = G.coords_of(F.col("_c"), dims)
    wanted = [F.struct(F.lit(lv).alias("level"), G.flat_key([F.shiftright(c, lv) for c in at], G.dims_at(dims, lv)).alias("key")) for lv in range(levels + 1)]
    keyed = placed.filter("_c >= 0").select("_c").distinct().select("_c", F.explode(F.array(*wanted)).alias("_w"))
    keyed = keyed.select("_c", F.col("_w.level").alias("_l"), F.col("_w.key").alias("_k"))
    hit = keyed.join(leaves.select(F.col("level").alias("_l"), F.col("key").alias("_k")), ["_l", "_k"])
    found = hit.groupBy("_c").agg(F.min(F.struct(F.col("_l").alias("level"), F.col("_k").alias("key"))).alias("_f"))
    return placed.join(found, "_c", "left").select(*points.columns, F.col("_f.level").alias("level"), F.col("_f.key").alias("key"))


def offsets(leaves: DataFrame, levels: int) -> DataFrame:
    """(level, leaves, first): leaves a level and the number of its first node, fine levels first."""
    from pyspark.sql import Window as W

    counts = leaves.groupBy("level").agg(F.count(F.lit(1)).alias("leaves"))
    w = W.partitionBy(F.lit(0)).orderBy("level").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("leaves").over(w), F.lit(0)))
