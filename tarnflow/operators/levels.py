"""Weighted quantiles and fits of all groups of a table at once, from sums only: no task holds a group.

``weighted_levels`` narrows an interval a group by histograms: a round sums the weights of ``BINS`` bins of every group's
interval, in partial aggregates, and goes on in the bin where the wanted weight is reached. A bin's own least and greatest
value are the next interval's ends, so they part in the next round, and a group ends when both are one value: exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.operators.session import round_of

BINS = 256
#: Groups, counted first, whose intervals are broadcast.
FEW = 20_000


def weighted_levels(rows: DataFrame, keys: Sequence[str], value: str, weight: Column, share: float) -> DataFrame:
    """(keys, level, weight): the least value up to which a group's weight is at least ``share`` of the whole, which is ``weight``.
    Null and NaN values and null weights don't count, nor do groups without weight. Exact where sums of weights are."""
    v = F.col("_v")
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v"), weight.alias("_w")).filter(v.isNotNull() & ~F.isnan(v) & F.col("_w").isNotNull())
    rows = round_of(rows.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), "_v", "_w"))
    k = [f"_k{n}" for n in range(len(keys))]
    whole = rows.groupBy(*k).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_w").alias("all"))
    state = round_of(whole.filter(F.col("all") > 0).withColumns({"before": F.col("all") * 0, "want": F.col("all").cast("double") * share}))
    done = []
    while True:
        done.append(state.filter("lo = hi"))
        state = round_of(state.filter("lo < hi"))
        open_ = state.count()
        if not open_:
            break
        at = state.select(*(F.col(c).alias(f"{c}_") for c in k), "lo", "hi")
        on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in k]
        inside = rows.join(F.broadcast(at) if open_ <= FEW else at, reduce(lambda a, b: a & b, [*on, v >= F.col("lo"), v <= F.col("hi")]))
        # Halves, so that a width beyond the range of doubles doesn't overflow; the greatest value has a bin of its own.
        place = F.floor((v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS).cast("int")
        bins = inside.groupBy(*k, F.when(v == F.col("hi"), BINS).otherwise(F.least(F.coalesce(place, F.lit(0)), F.lit(BINS - 1))).alias("bin")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_w").alias("w"))
        known = state.select(*(F.col(c).alias(f"{c}_") for c in k), "all", "before", "want")
        bins = bins.join(F.broadcast(known) if open_ <= FEW else known, reduce(lambda a, b: a & b, on))
        upto = F.col("before") + F.sum("w").over(W.partitionBy(*k).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))  # BINS + 1 rows at most
        reached = bins.withColumn("upto", upto).filter(F.col("upto") >= F.col("want"))
        first = reached.groupBy(*k).agg(F.min_by(F.struct("lo", "hi", "all", (F.col("upto") - F.col("w")).alias("before"), "want"), "bin").alias("m"))
        state = round_of(first.select(*k, "m.*"))
    out = reduce(DataFrame.union, done)
    return out.select(*(F.col(c).alias(name) for c, name in zip(k, keys, strict=True)), F.col("lo").alias("level"), F.col("all").alias("weight"))


def fitted_circles(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, cx, cy, radius): the circle of each group whose squared distances fit best (Kåsa's fit), from second moments;
    null for points on a line. A point is on it where |p|² - 2 c.p is constant, so c solves a system of covariances."""
    z = F.col(x) * F.col(x) + F.col(y) * F.col(y)
    m = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("_x"), F.avg(y).alias("_y"),
        F.covar_pop(x, x).alias("_xx"), F.covar_pop(x, y).alias("_xy"), F.covar_pop(y, y).alias("_yy"), F.covar_pop(F.col(x), z).alias("_xz"), F.covar_pop(F.col(y), z).alias("_yz"),
    )
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    flat = det <= 1e-12 * (F.col("_xx") + F.col("_yy")) * (F.col("_xx") + F.col("_yy"))
    cx = (F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy")) / (2 * det)
    cy = (F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy")) / (2 * det)
    m = m.withColumns({"cx": F.when(~flat, cx), "cy": F.when(~flat, cy)})
    far = F.col("_xx") + F.col("_yy") + (F.col("_x") - F.col("cx")) ** 2 + (F.col("_y") - F.col("cy")) ** 2
    return m.select(*keys, "n", "cx", "cy", F.sqrt(far).alias("radius"))
