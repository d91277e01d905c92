"""Bounded samples of labelled documents, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, most: int) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled documents that ``learnable`` allows, the first by a hash of doc_id.

    Null ids and labels are left out; of several labels of a document the largest counts, of several texts the first by hash."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learnable)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(most)
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", body.alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
