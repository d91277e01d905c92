"""The exact nearest neighbour of every point, at any distance, in any number of dimensions.

Some of the others are pivots (``PIVOTS`` at most, the first by a hash; they and one row of figures each are all that the driver
sees). Every other belongs to its nearest pivot, whose ring is where its members are: between their least and
greatest distance from it. A point's distance to a pivot bounds its distance to the ring's members from below. Points look
into their rings in the order of these bounds, one ring in the first round, twice as many in each further one, and only as long as
a ring's bound isn't beyond the best found: then the point is closed. A ring's members are dealt into chunks and its visitors
into groups, so that a comparison is a matrix product of bounded size, however many meet at a ring.

Distances that agree to nine digits are ties: the smallest key is taken. Points whose vector is null or holds null or
non-finite entries, or has another length than the pivots, have no neighbour and are nobody's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.session import round_of

PIVOTS = 64
CHUNK, VISITORS = 1024, 4096
_DIGITS = 9


def _usable(df: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    df = df.select(F.col(key).cast("long").alias("key"), v.alias("v"))
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return df.filter(ok if size is None else ok & (F.size("v") == size))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))


def _closest(keys: np.ndarray, points: np.ndarray, other_keys: np.ndarray, others: np.ndarray) -> pd.DataFrame:
    """Of each point the nearest other: those nearest by the product are measured again by their differences."""
    rough = _distances(points, others)
    slack = 1e-6 * (1 + np.abs(points).max() + np.abs(others).max())
    i, j = np.nonzero(rough <= rough.min(axis=1)[:, None] + slack)
    exact = np.sqrt(np.square(points[i] - others[j]).sum(axis=1))
    found = pd.DataFrame({"at": i, "key": keys[i], "d": exact, "r": np.round(exact, _DIGITS), "other": other_keys[j]})
    return found.sort_values(["at", "r", "other"]).drop_duplicates("at")[["key", "d", "other"]]


def nearest(points: DataFrame, key: str, others: DataFrame, other_key: str, vector: str, pivots: int = PIVOTS) -> DataFrame:
    """(key, other, distance): of each usable point the nearest usable one of ``others``; keys are longs, once each."""
    them = _usable(others, other_key, vector)
    chosen = them.orderBy(F.xxhash64("key"), "key").limit(pivots).collect()
    schema = f"{key} long, other long, distance double"
    spark = points.sparkSession
    if not chosen:
        return spark.createDataFrame([], schema)
    size = len(chosen[0].v)
    centres = np.array([r.v for r in chosen if len(r.v) == size])
    shared = spark.sparkContext.broadcast(centres)
    slack = 1e-9 * (1 + float(np.abs(centres).max()))

    def to_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _distances(np.stack(b["v"].to_numpy()), shared.value)
                at = d.argmin(axis=1)
                yield pd.DataFrame({"key": b["key"], "v": b["v"], "pivot": at, "d": d[np.arange(len(b)), at]})

    rings = round_of(_usable(others, other_key, vector, size).mapInPandas(to_pivot, "key long, v array<double>, pivot int, d double"))
    figures = {r.pivot: r for r in rings.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}  # a row a pivot
    there = np.array(sorted(figures))
    lo, hi = (np.array([getattr(figures[p], c) for p in there.tolist()]) for c in ("lo", "hi"))
    bounds = spark.sparkContext.broadcast((there, lo, hi))
    chunks = F.create_map(*(F.lit(x) for p in there.tolist() for x in (int(p), -(-figures[p].n // CHUNK))))
    rings = round_of(rings.select("pivot", F.pmod(F.xxhash64("key"), chunks[F.col("pivot")]).alias("chunk"), F.col("key").alias("other"), F.col("v").alias("w")))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        which, low, high = bounds.value
        for b in batches:
            if len(b):
                d = _distances(np.stack(b["v"].to_numpy()), shared.value[which])
                bound = np.maximum(np.maximum(d - high, low - d), 0.0)
                at = np.lexsort((d, bound), axis=1)
                yield pd.DataFrame({"key": b["key"], "v": b["v"], "ring": list(which[at]), "bound": list(np.take_along_axis(bound, at, 1))})

    state = _usable(points, key, vector, size).mapInPandas(order, "key long, v array<double>, ring array<int>, bound array<double>")
    inf = F.lit(math.inf)
    state = round_of(state.select("*", inf.alias("d"), F.lit(None).cast("long").alias("other")))
    seen, step = 0, 1

    def compare(_: tuple, q: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(o):
            return pd.DataFrame({"key": [], "d": [], "other": []}).astype({"key": "int64", "d": "float64", "other": "int64"})
        return _closest(q["key"].to_numpy(), np.stack(q["v"].to_numpy()), o["other"].to_numpy(), np.stack(o["w"].to_numpy()))

    rounded = F.round("d", _DIGITS)
    while seen < len(there):
        ring = F.explode(F.slice(F.arrays_zip(F.col("ring").alias("ring"), F.col("bound").alias("bound")), seen + 1, step))
        visit = state.select("key", "v", "d", ring.alias("z")).filter(F.col("z.bound") <= F.col("d") + slack).select("key", "v", F.col("z.ring").alias("pivot"))
        visit = round_of(visit)
        crowds = {r.pivot: r["count"] for r in visit.groupBy("pivot").count().collect()}  # a row a pivot
        if not crowds:
            break
        groups = F.create_map(*(F.lit(x) for p, n in crowds.items() for x in (p, -(-n // VISITORS))))
        visit = visit.withColumn("crowd", F.pmod(F.xxhash64("key"), groups[F.col("pivot")])).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), (chunks[F.col("pivot")] - 1).cast("long"))))
        met = rings.filter(groups[F.col("pivot")].isNotNull()).withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), (groups[F.col("pivot")] - 1).cast("long"))))
        by = ["pivot", "chunk", "crowd"]
        found = visit.groupBy(*by).cogroup(met.groupBy(*by)).applyInPandas(compare, "key long, d double, other long")
        best = state.filter(F.col("other").isNotNull()).select("key", "d", "other").union(found)
        best = best.groupBy("key").agg(F.min(F.struct(rounded.alias("r"), "other", "d")).alias("m")).select("key", F.col("m.d").alias("_d"), F.col("m.other").alias("_o"))
        state = round_of(state.join(best, "key", "left").select("key", "v", "ring", "bound", F.coalesce("_d", "d").alias("d"), F.coalesce("_o", "other").alias("other")))
        seen, step = seen + step, 2 * step
    return state.filter(F.col("other").isNotNull()).select(F.col("key").alias(key), "other", F.col("d").alias("distance"))
