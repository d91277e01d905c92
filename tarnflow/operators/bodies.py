"""Aggregates over bodies and compartments, top-first removal and layers: the arithmetic of pools."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.operators.order import ranked, running
from tarnflow.operators.session import round_of

#: Bodies, counted first, whose levels are broadcast.
FEW = 20_000


def body_stats(cells: DataFrame, body: str = "body", surface: str = "bath") -> DataFrame:
    """Of each body of cells (v, liquid, h, e, bath): volume, level (highest cell top reached) and free surface, the area of
    the cells that straddle the level; a body joined to the bath is unlimited (null volume and area) at the bath's level.

    Two aggregates, the levels of the first joined to the cells for the second; they are broadcast if they are few."""
    top = F.col("h") - F.col("e") + 2 * F.col("e") * F.col("liquid")
    levels = round_of(cells.groupBy(F.col(body).alias("_b")).agg(F.max(top).alias("_level")))
    few = levels.limit(FEW + 1).count() <= FEW
    df = cells.join(F.broadcast(levels) if few else levels, F.col(body).eqNullSafe(F.col("_b")), "left")
    straddles = (F.col("h") - F.col("e") < F.col("_level")) & (F.col("_level") <= F.col("h") + F.col("e"))
    out = df.groupBy(body).agg(
        F.bool_or(surface).alias("bath"),
        F.sum(F.col("liquid") * F.col("v")).alias("volume"),
        F.max("_level").alias("level"),
        F.sum(F.when(straddles & (F.col("e") > 0), F.try_divide(F.col("v"), 2 * F.col("e"))).otherwise(0.0)).alias("area"),
    )
    return out.withColumns({c: F.when(~F.col("bath"), F.col(c)) for c in ("volume", "area")})


def record_sums(cells: DataFrame, lab: str) -> DataFrame:
    """Sums of a step for every compartment and for all together (a null compartment) in one scan."""
    held = F.col("liquid") * F.col("v")
    sums = {
        "liquid": F.sum(held),
        "retained": F.sum(F.when(~F.col("bath"), held).otherwise(0.0)),
        "above_bath": F.sum(F.when(F.col("h") >= F.col("zb"), held).otherwise(0.0)),
        "air_below": F.sum(F.when(F.col("h") < F.col("zb"), (1 - F.col("liquid")) * F.col("v")).otherwise(0.0)),
        "air_trapped": F.sum(F.when(~F.col("air"), (1 - F.col("liquid")) * F.col("v")).otherwise(0.0)),
    }
    return cells.groupingSets([[F.col(lab)], []], F.col(lab)).agg(*(c.alias(k) for k, c in sums.items()), F.grouping_id().alias("whole"))


def take_top(cells: DataFrame, keys: Sequence[str], order: Sequence[Column], have: Column, amount: Column) -> DataFrame:
    """Adds ``taken``: ``amount`` removed from each group's cells in order, emptying one before the next."""
    before = F.coalesce(F.sum(have).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return cells.withColumn("taken", F.greatest(F.lit(0.0), F.least(have, amount - before)))


def layer_fill(cells: DataFrame, keys: Sequence[str], level: str, room: Column, amount: Column) -> DataFrame:
    """Adds ``filled``: cells filled lowest first; the cells of the layer that is filled in part share it by their room."""
    w = W.partitionBy(*keys).orderBy(level)
    upto = F.sum(room).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    layer = F.sum(room).over(W.partitionBy(*keys, level))
    left = amount - (upto - layer)
    return cells.withColumn("filled", room * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(left, layer), F.lit(0.0)))))


def crossing_times(series: DataFrame, keys: Sequence[str], t: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, share, t): the first time at which that share of the change from first to last value is done."""
    ordered = W.partitionBy(*keys).orderBy(t).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = series.withColumn("_a", F.first(value).over(ordered)).withColumn("_b", F.last(value).over(ordered))
    df = df.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares)))))
    done = F.abs(F.col(value) - F.col("_a")) >= F.col("share") * F.abs(F.col("_b") - F.col("_a")) - 1e-12
    return df.filter(done & (F.col("_a") != F.col("_b"))).groupBy(*keys, "share").agg(F.min(t).alias(t))


def upper_median(value: str) -> Column:
    """Element n / 2 of the sorted values of a numeric column, counted from 0: the lower median from above. Held as counts of
    distinct values, not as a list."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{value}`)")


def largest_gap(df: DataFrame, keys: Sequence[str], angle: str, turn: float = 360.0) -> DataFrame:
    """(keys, gap): the largest angular gap between neighbours round an axis, a whole turn for one angle."""
    w = W.partitionBy(*keys).orderBy(angle)
    whole = W.partitionBy(*keys)
    gap = F.coalesce(F.col(angle) - F.lag(angle).over(w), F.col(angle) + turn - F.max(angle).over(whole))
    return df.withColumn("gap", gap).groupBy(*keys).agg(F.max("gap").alias("gap"))


def weighted_centroid(df: DataFrame, keys: Sequence[str], weight: Column, axes: Sequence[str]) -> DataFrame:
    """Weight, centroid and extent of each group."""
    sums = [F.sum(weight).alias("weight")] + [F.try_divide(F.sum(weight * F.col(a)), F.sum(weight)).alias(f"c_{a}") for a in axes]
    return df.groupBy(*keys).agg(*sums, *(F.min(a).alias(f"min_{a}") for a in axes), *(F.max(a).alias(f"max_{a}") for a in axes))


def outflow(series: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, flow: Column) -> DataFrame:
    """Adds ``volume``: the flow of each step times the time since the one before, added up in the given order. Rows are in ranges of
    (keys, order), so a key of any length is many tasks: the time before is that of the row one place ahead."""
    placed = ranked(series, [*keys, *order], "_place")
    ahead = placed.select((F.col("_place") + 1).alias("_place"), F.col(t).alias("_t"), *(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)), F.lit(True))
    steps = placed.join(ahead, "_place", "left").withColumn("_s", F.abs(flow) * F.coalesce(F.when(same, F.col(t) - F.col("_t")), F.lit(0.0))).select(*series.columns, "_place", "_s")
    return running(steps, ["_place"], F.col("_s"), "volume", keys).select(*series.columns, "volume")


def settled(series: DataFrame, keys: Sequence[str], t: str, value: str, back: int, tol: float) -> DataFrame:
    """(keys, t): the first time at which the value has changed by less than ``tol`` of itself over the last ``back`` units of t."""
    w = W.partitionBy(*keys).orderBy(t)
    then = F.first(value).over(w.rangeBetween(-back, 0))
    old_enough = F.col(t) - F.first(t).over(w.rowsBetween(W.unboundedPreceding, 0)) >= back
    calm = F.abs(F.col(value) - then) <= tol * F.greatest(F.abs(F.col(value)), F.lit(1e-12))
    return series.withColumn("_c", calm & old_enough).filter("_c").groupBy(*keys).agg(F.min(t).alias(t))


def fingerprint(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(rows, digest) of a table, whatever the order of its rows."""
    return df.select(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("digest"))


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose values differ or that one side lacks, with what happened: added, removed or changed."""
    a = left.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full")
    what = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.withColumn("what", what).filter(F.col("what").isNotNull()).select(*keys, "what")


# ---- views and reports


def resampled(nodes: DataFrame, keys: Sequence[str], value: Column, weight: Column, node: Column) -> DataFrame:
    """(keys, mean, node, q): of each display cell the weighted mean of its nodes (at most 1), the heaviest node, the lowest on ties,
    and the mean in 255 steps."""
    mean = F.least(F.lit(1.0), F.sum(value * weight) / F.sum(weight))
    out = nodes.groupBy(*keys).agg(mean.alias("mean"), F.max_by(node, F.struct(weight, -node)).alias("node"))
    return out.withColumn("q", F.rint(255 * F.col("mean")).cast("int"))


def side_bodies(touching: DataFrame, keys: Sequence[str], body: str, level: str) -> DataFrame:
    """(keys, body, level): of the bodies that touch a side the one with the highest level, the lowest on ties."""
    return touching.groupBy(*keys).agg(F.max_by(body, F.struct(level, -F.col(body))).alias("body"), F.max(level).alias("level"))


def throat_air(faces: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """(keys, air_a, air_b, both): whether air stands at either side of a throat's faces, and at both sides of one of them."""
    return faces.groupBy(*keys).agg(F.bool_or(a).alias("air_a"), F.bool_or(b).alias("air_b"), F.bool_or(a & b).alias("both"))


def equal_shares(parts: DataFrame, keys: Sequence[str], value: Column, name: str = "share") -> DataFrame:
    """Adds each row's value over the number of rows that share its keys: counts are an aggregate, so a key of many rows stays spread."""
    counts = parts.groupBy(*(F.col(k).alias(f"_c{n}") for n, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("_n"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_c{n}")) for n, k in enumerate(keys)))
    return parts.join(counts, same).withColumn(name, value / F.col("_n")).select(*parts.columns, name)


def history(rows: DataFrame, moment: Column, name: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """A row a moment and a column a kind: how many rows there are of it, 0 for none."""
    wide = rows.groupBy(moment.alias(name)).pivot(kind, list(kinds)).agg(F.count(F.lit(1)))
    return wide.select(name, *(F.coalesce(c, F.lit(0)).alias(c) for c in kinds))


def largest(rows: DataFrame, key: str, size: Column, most: int) -> DataFrame:
    """(key, n, volume, total, rank): the bodies of the largest positive total size, with their rows and largest one; ``most`` rows at most."""
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("volume"), F.sum(size).alias("total")).filter("total > 0")
    order = [F.col("total").desc(), F.col(key)]
    return total.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def runs(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """(keys, run, first, n): runs of equal neighbours in order, numbered from 1 in each key: where one begins and how long it is.
    A key of any length is many ranges."""
    placed = ranked(rows.select(*keys, order, value), [*keys, order], "_place")
    ahead = placed.select((F.col("_place") + 1).alias("_place"), F.col(value).alias("_v"), *(F.col(k).alias(f"_r{n}") for n, k in enumerate(keys)))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_r{n}")) for n, k in enumerate(keys)), F.lit(True))
    goes_on = F.coalesce(same & (F.col(value) == F.col("_v")), F.lit(False))
    fresh = placed.join(ahead, "_place", "left").select(*keys, order, "_place", F.when(goes_on, 0).otherwise(1).alias("_f"))
    numbered = running(fresh, ["_place"], F.col("_f"), "run", keys)
    return numbered.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def facing(samples: DataFrame, line: str, place: str, label: str) -> DataFrame:
    """(a, b): pairs of labels, a < b, that are next to each other on a line: of neighbouring places, once each."""
    s = samples.select(line, place, F.col(label).alias("x")).distinct()
    partner = s.select(line, (F.col(place) - 1).alias(place), F.col("x").alias("y"))
    pairs = s.join(partner, [line, place]).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def sweep_inputs(cells: DataFrame, lab: Column, wet: Column, free: Column, poured: Column, h: str) -> DataFrame:
    """(lab, wet, source, top, low): of each compartment the wet cells, what is poured on its free cells, the highest of these and its lowest cell."""
    g = cells.groupBy(lab.alias("lab"))
    return g.agg(F.count_if(wet).alias("wet"), F.sum(F.when(free, poured).otherwise(0.0)).alias("source"), F.max(F.when(free, F.col(h))).alias("top"), F.min(h).alias("low"))
