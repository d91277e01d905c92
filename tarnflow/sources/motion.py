"""Keyframed motions as DataFrames: (t, ax, ay, az, sx, sy, sz), angles in degrees, and the pose at any time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.operators.order import running

COLUMNS = ("t", "ax", "ay", "az", "sx", "sy", "sz")
SCHEMA = ", ".join(f"{c} double" for c in COLUMNS)


def keyframes(spark: SparkSession, rows: Sequence[Sequence[float]]) -> DataFrame:
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], SCHEMA)


def static(spark: SparkSession, t_end: float = 10.0, angles: Sequence[float] = (0, 0, 0)) -> DataFrame:
    return keyframes(spark, [(t, *angles, 0, 0, 0) for t in (0.0, t_end)])


def dip(spark: SparkSession, depth: float = 0.4, start: float = 0.15, down: float = 4.0, hold: float = 0.0, up: float = 4.0, after: float = 0.0, tilt: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """Down by ``depth``, hold, up again, wait; segments without length are left out."""
    legs = [(0.0, start), (down, start - depth), (hold, start - depth), (up, start), (after, start)]
    rows, t = [], 0.0
    for k, (took, z) in enumerate(legs):
        t += took
        if not k or took > 0:
            rows.append((t, *tilt, 0, 0, z))
    return keyframes(spark, rows)


def turn(spark: SparkSession, axis: int = 1, t_in: float = 5.0, t_turn: float = 25.0, t_out: float = 5.0, depth: float = 2.0, hang: float = 0.0, sense: int = 1) -> DataFrame:
    """A dip with a full turn about one axis while under the surface, then hanging still."""
    angle = lambda a: tuple(a if k == axis else 0.0 for k in range(3))
    rows = [(0.0, *angle(0.0), 0, 0, 0), (t_in, *angle(0.0), 0, 0, -depth), (t_in + t_turn, *angle(360.0 * sense), 0, 0, -depth), (t_in + t_turn + t_out, *angle(360.0 * sense), 0, 0, 0)]
    if hang > 0:
        rows.append((rows[-1][0] + hang, *rows[-1][1:]))
    return keyframes(spark, rows)


def unwrapped(frames: DataFrame, by: str, t: str, angle: str) -> DataFrame:
    """Replaces an angle in degrees by one that goes the short way from each frame to the next."""
    w = W.partitionBy(by).orderBy(t)
    delta = F.col(angle) - F.lag(angle, 1).over(w)
    short = F.coalesce(delta - 360.0 * F.floor((delta + 180.0) / 360.0), F.col(angle))
    return frames.withColumn("_d", short).withColumn(angle, F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")


def segments(frames: DataFrame, keys: Sequence[str], t: str, values: Sequence[str]) -> DataFrame:
    """Half-open pieces [t, t_next) with the values at both ends; the last piece never ends."""
    w = W.partitionBy(*keys).orderBy(t)
    return frames.select(*keys, F.col(t).alias("t0"), F.lead(t).over(w).alias("t1"), *values, *(F.lead(v).over(w).alias(f"{v}_next") for v in values))


def interpolated(frames: DataFrame, times: DataFrame, keys: Sequence[str], t: str, values: Sequence[str]) -> DataFrame:
    """(keys, at, values) at the times (keys, at), linear between frames, constant before the first and after the last.

    Times and frames of a key are put in one line, so a time finds the frames around it by a running last and next value:
    no range join, one shuffle on the keys."""
    line = frames.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_q"), *values).unionByName(times.select(*keys, F.col("at").alias("_t"), F.lit(1).alias("_q")), allowMissingColumns=True)
    before = W.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(1, W.unboundedFollowing)
    frame = F.when(F.col("_q") == 0, F.struct(F.col("_t").alias("t"), *values))
    line = line.withColumn("_a", F.last(frame, ignorenulls=True).over(before)).withColumn("_b", F.first(frame, ignorenulls=True).over(after)).filter("_q = 1")
    share = F.try_divide(F.col("_t") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    lerp = lambda v: F.when(F.col("_a").isNull(), F.col(f"_b.{v}")).when(F.col("_b").isNull(), F.col(f"_a.{v}")).otherwise(F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * share)
    return line.select(*keys, F.col("_t").alias("at"), *(lerp(v).alias(v) for v in values))


def frames_at(poses: DataFrame, pivot: Sequence[float] = (0, 0, 0), level: float = 0.0) -> DataFrame:
    """Adds the up vector in object coordinates (ux, uy, uz) and the bath's height along it (zb)."""
    up = G.up_vector([F.col(c) for c in ("ax", "ay", "az")])
    df = poses.withColumns(dict(zip(("ux", "uy", "uz"), up, strict=True)))
    return df.withColumn("zb", G.bath_height([F.col(c) for c in ("ux", "uy", "uz")], F.col("sz"), pivot, level))


def speed_bound(frames: DataFrame, keys: Sequence[str], extent: float) -> DataFrame:
    """Adds how fast the bath moves past the object at most, from each frame to the next."""
    w = W.partitionBy(*keys).orderBy("at")
    step = {c: F.lead(c).over(w) - F.col(c) for c in ("at", "ux", "uy", "uz", "zb")}
    turned = F.sqrt(step["ux"] ** 2 + step["uy"] ** 2 + step["uz"] ** 2)
    return frames.withColumn("speed", F.try_divide(F.abs(step["zb"]) + turned * extent, step["at"]))


def frames(phases: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, frame, t, movie): the frames of phases (length, step, rate: seconds of film a second), one phase after another for each
    of ``keys``, numbered from 1 with their time and film time at the end. A key may have any number of phases."""
    n = F.rint(F.col("length") / F.col("step")).cast("long")
    begun = running(phases.withColumn("_n", n), [order], F.col("_n"), "_last", keys)
    begun = running(begun, [order], F.col("_n") * F.col("step"), "_t", keys)
    begun = running(begun, [order], F.col("_n") * F.col("step") * F.col("rate"), "_m", keys)
    each = begun.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))  # frames that come after this one
    return each.select(*keys, (F.col("_last") - F.col("_k")).alias("frame"), (F.col("_t") - F.col("_k") * F.col("step")).alias("t"), (F.col("_m") - F.col("_k") * F.col("step") * F.col("rate")).alias("movie"))
