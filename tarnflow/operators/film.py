"""Wall films: flow from element to element down a surface, deposits, puddles and drops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.physics import WATER, FilmParams


def directed(elements: DataFrame, edges: DataFrame, fluid: float = WATER.rho * WATER.g / (3 * WATER.mu)) -> DataFrame:
    """(src, dst, w): how fast film runs over an edge (ei, ej, length, mi: slope out of ei, mj: out of ej) out of dry elements."""
    dry = elements.filter("not sub").select("elem")
    both = edges.select(F.col("ei").alias("src"), F.col("ej").alias("dst"), "length", F.col("mi").alias("m")).union(edges.select("ej", "ei", "length", "mj"))
    return both.filter("m > 0").join(dry.withColumnRenamed("elem", "src"), "src", "left_semi").select("src", "dst", (fluid * F.col("length") * F.col("m")).alias("w"))


def outflow_rates(weights: DataFrame) -> DataFrame:
    return weights.groupBy(F.col("src").alias("elem")).agg(F.sum("w").alias("rate"))


def levels(weights: DataFrame) -> DataFrame:
    """(elem, level): the longest way from an element that nothing runs into; elements of a level can be swept together.
    Film that runs in a circle has no levels: an error."""
    from tarnflow.operators.session import round_of

    nodes = weights.select(F.col("src").alias("elem")).union(weights.select("dst")).distinct()
    at = round_of(nodes.withColumn("level", F.lit(0)))
    most = at.count()  # no way without a circle is longer
    for _ in range(most + 1):
        step = at.join(weights, at["elem"] == weights["src"]).groupBy(F.col("dst").alias("elem")).agg((F.max("level") + 1).cast("int").alias("level"))
        better = round_of(at.select("elem", "level").join(step.withColumnRenamed("level", "_l"), "elem", "left").select("elem", F.greatest("level", F.coalesce("_l", F.lit(0))).alias("level")))
        changed = not better.exceptAll(at).isEmpty()
        at = better
        if not changed:
            return at
    raise ValueError("film runs in a circle")


def flags(now: Column, before: Column) -> tuple[Column, Column]:
    """(submerged, emerged) from the liquid share of an element's cell."""
    return now >= 0.5, before & (now < 0.5)


def puddle(h: Column, up_n: Column, dry: Column, area: Column, p: FilmParams = FilmParams()) -> Column:
    """Volume above the bulk thickness on elements that face up, which becomes liquid of the cell."""
    return F.when(dry & (up_n >= p.hang_normal) & (h > p.h_bulk), (h - p.h_bulk) * area).otherwise(0.0)


def hangs(h: Column, up_n: Column, dry: Column, p: FilmParams = FilmParams()) -> Column:
    return dry & (up_n < 0) & (h > p.hang_min)


def swept(elements: DataFrame, weights: DataFrame, dt: float, p: FilmParams = FilmParams()) -> DataFrame:
    """One step of backward-Euler sub-steps over films (film_id, elem, height, h, area, sub) with weights (film_id, src, dst, w):
    elements from high to low each solve A h + dt C h^3 = V + inflow; what runs into submerged elements leaves. Returns
    (film_id, elem, h, absorbed). A film is a group: a carrier's connected part."""

    def sweep(key: tuple, el: pd.DataFrame, we: pd.DataFrame) -> pd.DataFrame:
        el = el.sort_values(["height", "elem"], ascending=[False, True], ignore_index=True)
        ids = el["elem"].to_numpy()
        place = {e: k for k, e in enumerate(ids.tolist())}
        n = len(ids)
        area, sub = el["area"].to_numpy(float), el["sub"].to_numpy(bool)
        out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for s, d, w in zip(we["src"], we["dst"], we["w"], strict=True):
            out[place[s]].append((place[d], float(w)))
        total = np.array([sum(w for _, w in o) for o in out])
        volume, absorbed = el["h"].to_numpy(float) * area, np.zeros(n)
        rounds = max(1, int(np.ceil(dt / p.dt_film)))
        step = dt / rounds
        for _ in range(rounds):
            for i in range(n):
                v = volume[i]
                if v <= 0 or total[i] <= 0 or sub[i]:
                    continue
                h = v / area[i]
                for _ in range(30):  # Newton on a rising, convex function from above: no step goes past the root
                    f = area[i] * h + step * total[i] * h**3 - v
                    new = h - f / (area[i] + 3 * step * total[i] * h * h)
                    if abs(new - h) <= 1e-15 + 1e-12 * h:
                        h = new
                        break
                    h = new
                left = min(v, area[i] * h)
                for k, w in out[i]:
                    share = (v - left) * w / total[i]
                    if sub[k]:
                        absorbed[k] += share
                    else:
                        volume[k] += share
                volume[i] = left
        return pd.DataFrame({"film_id": key[0], "elem": ids, "h": volume / area, "absorbed": absorbed})

    elements, weights = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (elements, weights))
    return elements.groupBy("film_id").cogroup(weights.groupBy("film_id")).applyInPandas(sweep, "film_id long, elem long, h double, absorbed double")


def drops(hanging: DataFrame, p: FilmParams = FilmParams()) -> DataFrame:
    """Of hanging film (group, elem, h, area, cell, height): (group, drops, volume, cell): whole drops that fall and the cell
    they fall from, the lowest of the group."""
    g = hanging.groupBy("group").agg(F.sum(F.col("h") * F.col("area")).alias("held"), F.min_by("cell", F.struct("height", "elem")).alias("cell"))
    n = F.floor(F.col("held") / p.drop_volume)
    return g.filter(F.col("held") >= p.drop_volume).select("group", n.alias("drops"), (n * p.drop_volume).alias("volume"), "cell")


def after_drops(hanging: DataFrame, fallen: DataFrame) -> DataFrame:
    """Adds ``taken``: what the drops of a group take, from its thickest elements first."""
    from tarnflow.operators.bodies import take_top

    df = hanging.join(fallen.select("group", F.col("volume").alias("_v")), "group", "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    return take_top(df, ["group"], [F.col("h").desc(), F.col("elem")], F.col("h") * F.col("area"), F.col("_v")).drop("_v")
