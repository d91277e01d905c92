"""Cells in finer and coarser views: sub-cells and their links, shared volumes, spreading to a display grid, narrow passages."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.operators import graph, near, session
from tarnflow.operators.components import connected_components
from tarnflow.operators.session import never_sent

AXES = ("i", "j", "k")
#: The 20 steps to cells that share an edge or a corner, and the 26 to all neighbours.
CORNER_STEPS = [s for s in product((-1, 0, 1), repeat=3) if sum(map(abs, s)) > 1]
ALL_STEPS = [s for s in product((-1, 0, 1), repeat=3) if any(s)]


def _steps(steps: Sequence[tuple[int, ...]]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(a) for v, a in zip(s, AXES, strict=True))) for s in steps))


def links_by(cells: DataFrame, steps: Sequence[tuple[int, ...]], half: bool = False) -> DataFrame:
    """(src, dst) of cells (node_id, i, j, k) that lie a step apart; with ``half`` each pair once, src < dst."""
    back = {tuple(-v for v in s) for s in steps}
    once = half and back == set(steps) and (0, 0, 0) not in back
    if once:  # of a step and the one back, one finds the pair
        steps = [s for s in steps if s > (0, 0, 0)]
    there = cells.select(F.col("node_id").alias("src"), *AXES, F.explode(_steps(steps)).alias("s")).select("src", *((F.col(a) + F.col(f"s.{a}")).alias(a) for a in AXES))
    out = there.join(never_sent(cells.select(F.col("node_id").alias("dst"), *AXES)), list(AXES)).select("src", "dst")
    if once:
        return out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return out.filter("src < dst") if half else out


def subcells(cells: DataFrame, k: int) -> DataFrame:
    """Each cell (node_id, i, j, k) as its k^3 sub-cells: (host, i, j, k) in sub-cell indices."""
    df = cells.select(F.col("node_id").alias("host"), *AXES)
    for a in AXES:
        df = df.withColumn(a, F.explode(F.sequence(F.col(a) * k, F.col(a) * k + k - 1)))
    return df


def cut_cells(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Solid cells with a fluid face neighbour. ``links`` are all face links, whatever the cells are."""
    fluid = cells.filter("not solid").select(F.col("node_id").alias("dst"))
    beside = links.join(never_sent(fluid), "dst", "left_semi").select(F.col("src").alias("node_id"))
    return cells.filter("solid").join(never_sent(beside), "node_id", "left_semi")


def fine_links(sub: DataFrame, coarse: DataFrame, k: int) -> DataFrame:
    """(kind, src, dst): face links of open sub-cells (id, host, i, j, k) among each other, and to open coarse cells
    (node_id, i, j, k) where a sub-cell's neighbour lies in one."""
    faces = [s for s in product((-1, 0, 1), repeat=3) if sum(map(abs, s)) == 1]
    inner = links_by(sub.select(F.col("id").alias("node_id"), *AXES), faces, half=True).select(F.lit("fine").alias("kind"), "src", "dst")
    there = sub.select(F.col("id").alias("src"), *AXES, F.explode(_steps(faces)).alias("s"))
    up = there.select("src", *(F.floor((F.col(a) + F.col(f"s.{a}")) / k).cast("long").alias(a) for a in AXES))
    outer = up.join(never_sent(coarse.select(F.col("node_id").alias("dst"), *(F.col(a).cast("long") for a in AXES))), list(AXES)).select(F.lit("coarse"), "src", "dst")
    return inner.union(outer)


def shared_volumes(solid_sub: DataFrame, near_labels: DataFrame, unit: float) -> DataFrame:
    """(label, volume): each closed sub-cell's volume in equal parts to the labels next to it (id, label)."""
    # Dealt once by sub-cell for all that follows, into parts that aren't joined again: a table's pairs are far larger than its file.
    # An inner join, for a semi-join would be pushed below the dealing.
    pairs = session.spread(near_labels.select("id", "label"), "id").join(solid_sub.select("id").distinct(), "id").distinct()
    shared = pairs.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("id")))
    return shared.groupBy("label").agg(F.sum(unit / F.col("n")).alias("volume"))


def spread(nodes: DataFrame, value: str, dx: float, origin: Sequence[float], dims: Sequence[int]) -> DataFrame:
    """(i, j, k, value): the volume-weighted mean of node values (x, y, z, size) over the display cells that they cover; a
    node smaller than a cell counts where its centre is."""
    df = nodes
    for a, p, o, n in zip(AXES, "xyz", origin, dims, strict=True):
        lo = F.floor((F.col(p) - 0.5 * F.col("size") - o) / dx + 1e-9)
        hi = F.ceil((F.col(p) + 0.5 * F.col("size") - o) / dx - 1e-9) - 1
        own = F.floor((F.col(p) - o) / dx)
        lo, hi = (F.when(F.col("size") > dx, x).otherwise(own).cast("int") for x in (lo, hi))
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n - 1))
        df = df.withColumn(a, F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    cover = F.pow(F.least(F.col("size"), F.lit(float(dx))), F.lit(3.0))
    return df.groupBy(*AXES).agg(F.least(F.lit(1.0), F.sum(F.col(value) * cover) / F.sum(cover)).alias(value))


def into_solid(fluid: DataFrame, solid: DataFrame, value: str) -> DataFrame:
    """(node_id, value) of solid cells: the largest value of a fluid cell among their 26 neighbours, where there is one."""
    there = solid.select("node_id", *AXES, F.explode(_steps(ALL_STEPS)).alias("s")).select("node_id", *((F.col(a) + F.col(f"s.{a}")).alias(a) for a in AXES))
    return there.join(never_sent(fluid.select(*AXES, value)), list(AXES)).groupBy("node_id").agg(F.max(value).alias(value))


def flat_levels(cells: DataFrame, body: str = "body") -> DataFrame:
    """Cells (body, node_id, h, e, v, share) with ``flat``: the body's volume redistributed under one level plane. A body is a
    group; 40 bisections on its level."""

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        h, e, v = (pdf[c].to_numpy(float) for c in ("h", "e", "v"))
        held = float((pdf["share"].to_numpy(float) * v).sum())
        below = lambda z: np.clip((z - h + e) / np.maximum(2 * e, 1e-300), 0.0, 1.0)
        lo, hi = float((h - e).min()), float((h + e).max())
        for _ in range(40):
            mid = 0.5 * (lo + hi)
            lo, hi = (mid, hi) if (below(mid) * v).sum() < held else (lo, mid)
        return pdf[[body, "node_id"]].assign(flat=below(hi))

    schema = f"{body} {cells.schema[body].dataType.simpleString()}, node_id long, flat double"
    return cells.select(body, "node_id", "h", "e", "v", "share").groupBy(body).applyInPandas(level, schema)


def connecting(narrow: DataFrame, links: DataFrame, outside: DataFrame) -> DataFrame:
    """(passage): passages, components of narrow cells (node_id), that touch at least two of the regions outside (node_id,
    region); dead ends are left out."""
    p = graph.bodies(narrow, links)
    touched = links.join(p.select(F.col("node_id").alias("src"), F.col("body").alias("passage")), "src").join(outside.select(F.col("node_id").alias("dst"), "region"), "dst")
    return touched.groupBy("passage").agg(F.countDistinct("region").alias("regions")).filter("regions >= 2").select("passage")


def widest_clearance(nodes: DataFrame, links: DataFrame, side_a: DataFrame, side_b: DataFrame) -> float | None:
    """Twice the largest distance from the walls that a way from one side to the other keeps: a bottleneck path on the
    distance field (node_id, distance); None without a way."""
    d = nodes.select("node_id", "distance")
    w = links.join(d.select(F.col("node_id").alias("src"), F.col("distance").alias("da")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("distance").alias("db")), "dst")
    best = graph.widest_paths(w.select("src", "dst", F.least("da", "db").alias("width")), side_a.select("node_id"))
    found = best.join(side_b, "node_id", "left_semi").agg(F.max("width")).first()[0]
    return None if found is None else 2 * found


def voxelised(spark_cells: DataFrame, touched: DataFrame, links: DataFrame) -> DataFrame:
    """Cells (node_id, boundary) with ``solid``: what a mesh touches, and what no way from the boundary reaches."""
    closed = touched.select("node_id").distinct()
    open_ = spark_cells.join(closed, "node_id", "left_anti")
    cc = graph.connected_to(open_, links, F.col("boundary")).withColumn("_o", F.lit(True))
    return spark_cells.join(cc, "node_id", "left").withColumn("solid", F.col("_o").isNull()).drop("_o")


def facing_narrow(samples: DataFrame, dx: float, least: float, most: float) -> DataFrame:
    """(i, j, k) of cells where a sampled wall faces another one across a gap between ``least`` and ``most``."""
    band = samples.filter(F.col("facing") & (F.col("width") > least) & (F.col("width") < most))
    return band.select(*(F.floor(F.col(p) / dx).cast("int").alias(a) for p, a in zip("xyz", AXES, strict=True))).distinct()


def mesh_components(by_vertex: DataFrame, pairs: DataFrame) -> DataFrame:
    """(face_id, part): the connected parts of a mesh."""
    cc = connected_components(pairs).withColumnRenamed("node", "face_id")
    return by_vertex.select("face_id").join(cc, "face_id", "left").select("face_id", F.coalesce("component", "face_id").alias("part"))


def crossing_plane(links: DataFrame, nodes: DataFrame, holes: DataFrame, half: float) -> DataFrame:
    """(hole_id, src, dst): links that cross the middle plane of a round hole (hole_id, x, y, z, ax, ay, az, diameter; the axis is
    a unit vector) within its radius and half a cell. ``links`` once each. Links and holes meet in buckets: the foot of a link's
    middle on the plane is within half the link of the middle, and within the hole's radius and half a cell of its centre."""
    n = nodes.select("node_id", "x", "y", "z")
    ends = {p: never_sent(n.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{p}{c}_") for c in "xyz"))) for p, end in (("a", "src"), ("b", "dst"))}
    e = links.join(ends["a"], "src").join(ends["b"], "dst")
    a, b = ([F.col(f"{p}{c}_") for c in "xyz"] for p in "ab")
    e = e.select("src", "dst", *a, *b, *(((p + q) / 2).alias(c) for p, q, c in zip(a, b, "xyz", strict=True)), (G.length(G.minus(b, a)) / 2).alias("reach"))
    # A radius without end reaches all there is.
    reach = F.least(F.col("diameter") / 2 + half, F.lit(2.0**1000))
    h = holes.select("hole_id", *(F.col(c).cast("double").alias(f"h{c}") for c in "xyz"), "ax", "ay", "az", "diameter", *(F.col(c).cast("double").alias(c) for c in "xyz"), reach.alias("reach")).filter("reach >= 0")
    axis = [F.col(c) for c in ("ax", "ay", "az")]
    hole = [F.col(f"h{c}") for c in "xyz"]
    middle = [(p + q) / 2 - c for p, q, c in zip(a, b, hole, strict=True)]
    along = G.dot(middle, axis)
    off = G.length([m - along * x for m, x in zip(middle, axis, strict=True)])
    da, db = (G.dot(G.minus(p, hole), axis) for p in (a, b))
    met = near.met(e, h, "xyz", F.greatest(2 * F.col("reach"), F.lit(2.0 * half or 1.0)))
    return met.filter((da * db <= 0) & (da != db) & (off <= F.col("diameter") / 2 + half)).select("hole_id", "src", "dst")
