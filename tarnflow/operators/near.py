"""Spatial joins by buckets: points meet only points of the same or a neighbouring bucket, whatever the number of both."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.operators.session import never_sent


def bucket(x: Sequence[Column], size: float) -> list[Column]:
    return [F.floor(c / size).cast("long") for c in x]


def _around(points: DataFrame, axes: Sequence[str], size: float) -> DataFrame:
    """Each point once for each bucket within one of its own."""
    out = points
    for n, axis in enumerate(axes):
        out = out.withColumn(f"_b{n}", F.explode(F.array(*(F.floor(F.col(axis) / size).cast("long") + o for o in (-1, 0, 1)))))
    return out


def met(left: DataFrame, right: DataFrame, axes: Sequence[str], edge: Column) -> DataFrame:
    """Rows of both sides whose boxes (a place on ``axes`` and ``reach`` to all sides of it) may overlap, each pair once; the columns
    are the left ones and the right ones, whose names differ but for axes and reach. ``edge`` is a Column of the right side: buckets
    are as wide as the power of two above it, so sides may differ in size. A pair counts in the first bucket that both boxes hold."""

    def boxed(df: DataFrame, side: str) -> DataFrame:
        wide = F.pow(F.lit(2.0), F.col("_l"))
        for n, axis in enumerate(axes):
            far = F.col("reach") * (1 + 1e-9) + F.abs(F.col(axis)) * 1e-12
            lo, hi = (F.floor((F.col(axis) + sign * far) / wide).cast("long") for sign in (-1, 1))
            df = df.withColumn(f"_{side}{n}", lo).withColumn(f"_b{n}", F.explode(F.sequence(lo, hi)))
        return df.drop(*axes, "reach")

    placed = lambda df: df.filter(reduce(lambda a, b: a & b, (F.abs(F.col(c)) < float("inf") for c in (*axes, "reach"))))
    right = placed(right).withColumn("_l", F.ceil(F.log2(edge)).cast("int"))
    levels = [row[0] for row in right.select("_l").distinct().collect()]  # as many as doubles have exponents, at most
    if not levels:
        levels = [0]
    left = placed(left).withColumn("_l", F.explode(F.array(*map(F.lit, sorted(levels)))))
    keys = ["_l", *(f"_b{n}" for n in range(len(axes)))]
    both = boxed(left, "p").join(never_sent(boxed(right, "q")), keys)
    first = reduce(lambda a, b: a & b, (F.col(f"_b{n}") == F.greatest(f"_p{n}", f"_q{n}") for n in range(len(axes))))
    return both.filter(first).drop(*keys, *(f"_{s}{n}" for s in "pq" for n in range(len(axes))))


def radius_join(left: DataFrame, right: DataFrame, axes: Sequence[str], radius: float) -> DataFrame:
    """Pairs at most ``radius`` apart: the left columns, the right ones with prefix r_, and ``distance``."""
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), *(b.alias(f"_b{n}") for n, b in enumerate(bucket([F.col(a) for a in axes], radius))))
    joined = _around(left, axes, radius).join(r, [f"_b{n}" for n in range(len(axes))])
    apart = G.length(G.minus([F.col(a) for a in axes], [F.col(f"r_{a}") for a in axes]))
    return joined.withColumn("distance", apart).filter(F.col("distance") <= radius).drop(*(f"_b{n}" for n in range(len(axes))))


def capped_nearest(points: DataFrame, key: str, others: DataFrame, axes: Sequence[str], cap: float) -> DataFrame:
    """(key, distance) to the nearest of ``others``, the cap if none is nearer."""
    found = radius_join(points.select(key, *axes), others.select(*axes), axes, cap).groupBy(key).agg(F.min("distance").alias("d"))
    return points.select(key).join(found, key, "left").select(key, F.coalesce("d", F.lit(float(cap))).alias("distance"))


def inside_any(points: DataFrame, key: str, balls: DataFrame, axes: Sequence[str], largest: float) -> DataFrame:
    """(key) of points inside a ball (axes, radius) whose radius is at most ``largest``."""
    hit = radius_join(points.select(key, *axes), balls.select(*axes, "radius"), axes, largest)
    return hit.filter(F.col("distance") <= F.col("r_radius")).select(key).distinct()


def thinned(points: DataFrame, order: Sequence[str | Column], axes: Sequence[str], size: float, also: Sequence[str] = ()) -> DataFrame:
    """The first point of each cube of ``size`` (and of each value of ``also``) in the given order."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*bucket([F.col(a) for a in axes], size), *also).orderBy(*order)
    return points.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
