"""Places and running totals over whole tables, without a task that holds more than a partition of the sorted rows.

A table is sorted by range and checkpointed, so its partitions stay what they are; one row a partition (its count or total)
goes to the driver, and what lies before a partition comes back as a small table. Ties keep some order of their own:
give columns that decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.operators.session import round_of

#: Bits of a row's place in its partition.
_INSIDE = (1 << 33) - 1


def _sorted(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    return round_of(df.orderBy(*by)).withColumn("_part", F.spark_partition_id())


def ranked(df: DataFrame, by: Sequence[str | Column], name: str = "place") -> DataFrame:
    """Adds a row's place in the order of ``by``, from 0."""
    rows = _sorted(df, by).withColumn("_inside", F.monotonically_increasing_id().bitwiseAND(_INSIDE))
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    before = accumulate((n for _, n in counts), initial=0)
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part int, _before long")
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def running(df: DataFrame, by: Sequence[str | Column], value: Column, name: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds the sum of ``value`` over the rows up to this one in the order of ``by``, or of those with the same ``within``.

    Partitions are ranges of (within, by): each sums its own rows, and gets the total of the same ``within`` in the
    partitions before. A key of any size is many ranges, and only a range's last key goes on into the next."""
    rows = _sorted(df.withColumn("_value", value), [*within, *by])
    totals = rows.groupBy("_part", *within).agg(F.sum("_value").alias("_total"))
    # A key's totals: as many rows as partitions it spans, which are few for all keys but the long ones.
    carried = totals.withColumn("_before", F.sum("_total").over(W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).drop("_total")
    own = F.sum("_value").over(W.partitionBy("_part", *within).orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    if within:
        keys = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(within)]
        right = carried.filter(F.col("_before").isNotNull()).select(F.col("_part").alias("_p"), "_before", *(F.col(c).alias(f"_k{n}") for n, c in enumerate(within)))
        joined = rows.withColumn("_own", own).join(right, [F.col("_part") == F.col("_p"), *keys], "left")
    else:
        joined = rows.withColumn("_own", own).join(F.broadcast(carried), "_part", "left")
    return joined.withColumn(name, F.when(F.col("_before").isNull(), F.col("_own")).otherwise(F.col("_before") + F.coalesce("_own", F.lit(0)))).select(*df.columns, name)
