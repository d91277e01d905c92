"""Greedy merging of regions over the openings between them, many pairs a round.

Regions have a peak and a size, a pair its widest opening. A pair may merge while the opening reaches ``beta`` times the lower
peak, or ``r_free``, or a side is smaller than ``least``. The order is greedy: of all pairs that may, the one with a small side
and the widest opening for its lower peak comes first (ties: the ends of the link that is the opening), its regions become one
with the higher peak, the summed size and the wider opening to each neighbour, and so on. A merge never moves a pair up in
the order, nor lets one merge that might not before. So two regions that are each other's first choice merge in the
greedy order too, whatever happens elsewhere, and so does a region with its first choice if the other has no lower
peak and isn't small, since nothing the other does before changes that pair. All these are contracted in one round. (A chain of rising peaks has one such pair
at a time, and takes a round for each until few are left.)
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.forest import followed
from tarnflow.operators.session import round_of

#: Pairs, counted first, from which one task goes on alone.
FEW = 20_000


class Rule:
    def __init__(self, beta: float, r_free: float, least: float) -> None:
        self.beta, self.r_free, self.least = beta, r_free, least

    def scored(self, pairs: DataFrame, regions: DataFrame) -> DataFrame:
        """Pairs that may merge, with their place in the order (``key``: smaller first) and what the sides are like."""
        out = pairs
        for s in ("a", "b"):
            out = out.join(regions.select(F.col("label").alias(s), F.col("peak").alias(f"{s}p"), F.col("size").alias(f"{s}s")), s)
        low = F.least("ap", "bp")
        small = F.least("as", "bs") < self.least
        may = (F.col("w") >= self.beta * low) | (F.col("w") >= self.r_free) | small
        score = F.col("w") / F.greatest(low, F.lit(1e-300))
        return out.filter(may).withColumn("key", F.struct((~small).alias("large"), (-score).alias("score"), "u", "v"))

    def one_by_one(self, regions: pd.DataFrame, pairs: pd.DataFrame) -> Iterator[tuple[int, int]]:
        """The same in one task: a heap of pairs; one whose key is not what it was is left out, its new key is there too."""
        peak, size = dict(zip(regions["label"], regions["peak"], strict=True)), dict(zip(regions["label"], regions["size"], strict=True))
        near: dict[int, dict[int, tuple[float, int, int]]] = {}
        for a, b, w, u, v in pairs[["a", "b", "w", "u", "v"]].itertuples(index=False):
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = (-w, u, v)

        def key(a: int, b: int) -> tuple[bool, float, int, int] | None:
            w, u, v = near[a][b]
            low, small = min(peak[a], peak[b]), min(size[a], size[b]) < self.least
            return (not small, w / max(low, 1e-300), u, v) if -w >= self.beta * low or -w >= self.r_free or small else None

        heap = [(k, a, b) for a in near for b in near[a] if a < b and (k := key(a, b))]
        heapq.heapify(heap)
        while heap:
            k, a, b = heapq.heappop(heap)
            if a not in near or b not in near[a] or key(a, b) != k:
                continue
            del near[a][b], near[b][a]
            peak[a], size[a] = max(peak[a], peak[b]), size[a] + size[b]
            for c, way in near.pop(b).items():
                del near[c][b]
                near[a][c] = near[c][a] = min(way, near[a].get(c, way))
            for c in near[a]:
                x, y = min(a, c), max(a, c)
                if new := key(x, y):
                    heapq.heappush(heap, (new, x, y))
            yield b, a


def merged(regions: DataFrame, pairs: DataFrame, beta: float = 0.7, r_free: float = 0.01, least: float = 0.0, few: int = FEW) -> DataFrame:
    """(label, into): regions (label, peak, size) merged over pairs (a, b, opening); ``into`` is the smallest label of a region's
    own. Pairs with an end that isn't there, or null, are left out. Each round contracts all pairs that are settled; when
    ``few`` are left, one task finishes by the same rule."""
    rule = Rule(beta, r_free, least)
    at = round_of(regions.select("label", F.col("peak").cast("double").alias("peak"), F.col("size").cast("double").alias("size")))
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("opening").cast("double").alias("w"), (F.col("a") != F.col("b")).alias("ok")).filter("ok and w is not null")
    p = p.groupBy("a", "b").agg(F.max("w").alias("w")).withColumns({"u": F.col("a"), "v": F.col("b")})
    maps: list[DataFrame] = []
    while True:
        p = round_of(rule.scored(p, at))
        left = p.count()
        if left <= few:
            break
        best = p.select(F.col("a").alias("label"), "key", F.col("b").alias("to"), F.col("ap").alias("own"), F.col("bp").alias("its"), F.col("bs").alias("room"))
        best = best.union(p.select("b", "key", "a", "bp", "ap", "as")).groupBy("label").agg(F.min(F.struct("key", "to", "own", "its", "room")).alias("m")).select("label", "m.*")
        best = round_of(best)
        back = best.select(F.col("label").alias("_l"), F.col("to").alias("_t"))
        both = best.join(back, F.col("to") == F.col("_l")).withColumn("mutual", F.col("_t") == F.col("label"))
        settled = (F.col("own") <= F.col("its")) & (F.col("room") >= rule.least)
        # Of a pair that chose each other the smaller label stays; else the pointer leads to the choice.
        hooks = both.filter("mutual or own <= its").filter(F.col("mutual") | settled)
        hooks = hooks.select(F.col("label").alias("node"), F.when(F.col("mutual") & (F.col("label") < F.col("to")), F.col("label")).otherwise(F.col("to")).alias("to"))
        ends = followed(hooks)
        group = at.join(ends, F.col("label") == F.col("node"), "left").join(ends.select(F.col("end").alias("_e")).distinct(), F.col("label") == F.col("_e"), "left_semi").select("label", F.col("label").alias("end"))
        group = ends.select(F.col("node").alias("label"), "end").union(group).distinct()
        names = group.groupBy("end").agg(F.min("label").alias("into"))
        step = round_of(group.join(names, "end").filter("label <> into").select("label", "into"))
        maps.append(step)
        m = step.select(F.col("label").alias("_l"), F.col("into").alias("_i"))
        at = at.join(m, F.col("label") == F.col("_l"), "left").groupBy(F.coalesce("_i", "label").alias("label")).agg(F.max("peak").alias("peak"), F.sum("size").alias("size"))
        at = round_of(at)
        for s in ("a", "b"):
            p = p.join(m, F.col(s) == F.col("_l"), "left").withColumn(s, F.coalesce("_i", s)).drop("_l", "_i")
        p = p.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct((-F.col("w")).alias("n"), "u", "v")).alias("m"))
        p = p.select("a", "b", (-F.col("m.n")).alias("w"), "m.u", "m.v")
    if left:
        ends = p.select(F.col("a").alias("label")).union(p.select("b")).distinct()
        rest = at.join(ends, "label", "left_semi").withColumn("g", F.lit(0))

        def finish(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(list(rule.one_by_one(r, q)), columns=["node", "to"]).astype("int64")

        last = rest.groupBy("g").cogroup(p.withColumn("g", F.lit(0)).groupBy("g")).applyInPandas(finish, "node long, to long")  # ``few`` pairs at most
        maps.append(followed(last).select(F.col("node").alias("label"), F.col("end").alias("into")))

    def through(df: DataFrame, step: DataFrame) -> DataFrame:
        m = step.select(F.col("label").alias("_l"), F.col("into").alias("_i"))
        return df.join(m, F.col("into") == F.col("_l"), "left").select(df["label"], F.coalesce("_i", "into").alias("into"))

    return reduce(through, maps, regions.select("label", F.col("label").alias("into")))
