"""Compartments of a raster: distance to the walls, watershed from its maxima, merging, and the throats between.

Distances, face pairs and throats are table operators. ``watershed`` keeps the order of arrival and runs as one group a scenario;
``forest.watershed`` floods one large graph, ``merging.merged`` joins its regions.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import near
from tarnflow.operators.components import connected_components
from tarnflow.operators.order import running


def wall_distance(fluid: DataFrame, solid: DataFrame, dx: float, cap: float, axes: str = "xyz") -> DataFrame:
    """(node_id, distance) from a fluid cell's centre to the nearest solid cell's face, at least half a cell, at most the cap."""
    d = near.capped_nearest(fluid.select("node_id", *axes), "node_id", solid.select(*axes), axes, cap)
    return d.select("node_id", (F.rint(F.greatest(F.col("distance") - 0.5 * dx, F.lit(0.5 * dx)) * 1e10) / 1e10).alias("distance"))


def maxima(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, marker): plateaus of the distance that no linked cell exceeds; a marker is named by its lowest cell."""
    d = nodes.select("node_id", "distance")
    pair = links.join(d.select(F.col("node_id").alias("src"), F.col("distance").alias("da")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("distance").alias("db")), "dst")
    flat = connected_components(pair.filter("da = db and src < dst").select("src", "dst")).withColumnRenamed("node", "node_id")
    p = d.join(flat, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("marker"))
    lower = pair.filter("db > da").select(F.col("src").alias("node_id")).distinct().join(p, "node_id").select("marker").distinct()
    return p.join(lower, "marker", "left_anti").select("node_id", "marker")


def watershed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Spreads labels (scenario_id, node_id, distance, label or null) to the cells that reach them first, the largest distance
    first, then the order of arrival. A scenario is one group."""

    def flood(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("node_id", ignore_index=True)
        ids, d = n["node_id"].to_numpy(), n["distance"].to_numpy()
        label = n["label"].fillna(-1).to_numpy(np.int64).copy()
        src, dst = (np.searchsorted(ids, e[c].to_numpy()) for c in ("src", "dst"))
        order = np.lexsort((dst, src))
        first = np.searchsorted(src[order], np.arange(len(ids) + 1))
        dst = dst[order]
        heap = [(-d[i], k, int(i)) for k, i in enumerate(np.flatnonzero(label >= 0))]
        heapq.heapify(heap)
        age = len(heap)
        while heap:
            _, _, i = heapq.heappop(heap)
            for m in dst[first[i] : first[i + 1]].tolist():
                if label[m] < 0:
                    label[m] = label[i]
                    heapq.heappush(heap, (-d[m], age, m))
                    age += 1
        return pd.DataFrame({"scenario_id": key[0], "node_id": ids, "label": label})

    nodes, links = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (nodes, links))
    return nodes.groupBy("scenario_id").cogroup(links.groupBy("scenario_id")).applyInPandas(flood, "scenario_id long, node_id long, label long")


def region_pairs(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, opening, faces): for two labels a < b the largest distance at which they meet, and on how many faces."""
    n = nodes.select("node_id", "label", "distance")
    p = links.join(n.select(F.col("node_id").alias("src"), F.col("label").alias("a"), F.col("distance").alias("da")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("label").alias("b"), F.col("distance").alias("db")), "dst")
    return p.filter("a < b").groupBy("a", "b").agg(F.max(F.least("da", "db")).alias("opening"), F.count(F.lit(1)).alias("faces"))


def exterior_zero(nodes: DataFrame) -> DataFrame:
    """Labels (node_id, label, boundary) with all that touch the boundary as 0 and the others numbered from 1, ascending."""
    open_ = nodes.groupBy("label").agg(F.bool_or("boundary").alias("open"))
    ranks = running(open_, ["label"], F.when(F.col("open"), 0).otherwise(1), "number").withColumn("number", F.when(F.col("open"), 0).otherwise(F.col("number")))
    return nodes.join(ranks.select("label", "number"), "label").select("node_id", F.col("number").cast("long").alias("label"))


def throats(nodes: DataFrame, links: DataFrame, dx: float) -> DataFrame:
    """(a, b, throat, faces, area, diameter, x, y, z): openings between compartments: faces of a pair that touch each other
    (within one cell in every direction) are one. The area is that of the faces' summed normals, at least faces / sqrt(3)."""
    n = nodes.select("node_id", "label", "distance", "x", "y", "z")
    f = links.join(n.select(F.col("node_id").alias("src"), *(F.col(c).alias(f"s{c}") for c in ("label", "distance", "x", "y", "z"))), "src").join(n.select(F.col("node_id").alias("dst"), *(F.col(c).alias(f"d{c}") for c in ("label", "distance", "x", "y", "z"))), "dst")
    f = f.filter("slabel < dlabel").select(F.col("slabel").alias("a"), F.col("dlabel").alias("b"), F.xxhash64("src", "dst").alias("face"), F.least("sdistance", "ddistance").alias("d"), *(((F.col(f"s{c}") + F.col(f"d{c}")) / 2).alias(c) for c in "xyz"), *(F.signum(F.round((F.col(f"d{c}") - F.col(f"s{c}")) / dx)).alias(f"n{c}") for c in "xyz"))
    touch = near.radius_join(f.select("face", "a", "b", "x", "y", "z"), f.select("face", "a", "b", "x", "y", "z"), "xyz", 1.7321 * dx)
    touch = touch.filter("face < r_face and a = r_a and b = r_b").filter(F.greatest(*(F.abs(F.col(f"r_{c}") - F.col(c)) for c in "xyz")) <= 1.01 * dx)
    cc = connected_components(touch.select(F.col("face").alias("src"), F.col("r_face").alias("dst")))
    f = f.join(cc.withColumnRenamed("node", "face"), "face", "left").withColumn("throat", F.coalesce("component", "face"))
    net = F.sqrt(F.sum("nx") ** 2 + F.sum("ny") ** 2 + F.sum("nz") ** 2)
    return f.groupBy("a", "b", "throat").agg(F.count(F.lit(1)).alias("faces"), (F.greatest(net, F.count(F.lit(1)) / F.sqrt(F.lit(3.0))) * dx * dx).alias("area"), (2 * F.max("d") + 0.5 * dx).alias("diameter"), *(F.avg(c).alias(c) for c in "xyz"))
