"""Cutting lineage where a plan grows by iteration."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoints in the shared folder that the session names. A session of one machine that names none gets a temporary one;
    a cluster must name one that its machines share."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tarnflow-"))
    return df.checkpoint()


def round_of(df: DataFrame) -> DataFrame:
    """Checkpoints the table that a loop goes on with, and forgets the size that its plan was thought to have.

    A checkpointed table keeps that estimate, a join's is the product of its sides', and so a loop's grows to a number of
    millions of digits, which fills the driver's memory. The rows and their partitions are the checkpoint's."""
    done, spark = checkpointed(df), df.sparkSession
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def stage_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, for a table that a later step reads again."""
    checkpointed(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deals rows that each are much work, and so may be one small file's, to all tasks: a number of partitions that
    adaptive execution doesn't join again."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def never_sent(df: DataFrame) -> DataFrame:
    """A side of a join that goes by shuffle. Its rows grow with the tables, but a compressed file's size, from which the optimizer
    judges it, is far below theirs and doesn't know of rows that a generator adds; it would be sent whole through the driver."""
    return df.hint("merge")
