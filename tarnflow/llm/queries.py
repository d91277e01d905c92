"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import decontaminate, embeddings, html, infill, language, licences, mixing, oracles, pii, quality, secrets, simhash, toxicity, whitening
from tarnflow.llm import spans as S
from tarnflow.llm.common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_secret_scan": oracles.SECRETS, "op4_decontaminate": oracles.DECONTAMINATE, "op7_embedding_dedup": oracles.EMBEDDINGS, "op12_fill_in_middle": oracles.INFILL}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in secrets.BASE),
        F.sha2(S.written(F.col("base")), 256).alias("base_sha256"),
        S.written(F.col("secret_spans")).alias("spans"),
    )


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), carry=["doc_id"])


def _judged(scored: DataFrame, held_out: tuple[int, int], threshold: float) -> DataFrame:
    modulus, left_out = held_out
    return scored.select("doc_id", F.coalesce(fold("doc_id", modulus) == left_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")), without=("text",)), quality.HELD_OUT, quality.THRESHOLD)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")), without=("text",)), toxicity.HELD_OUT, toxicity.THRESHOLD)


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), size=4, words=1, radius=4)
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"), carry=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.scan(docs, pii.train(docs))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(S.written(F.col("base")), 256).alias("base_sha256"),
        S.written(F.col("pii_spans")).alias("spans"),
    )


@query
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source's documents of a language are a directory of the source's."""
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    files = read(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", part("source"), part("lang"), F.col("doc_id").cast("string")).alias("path"))
    return licences.scan(files).withColumn("similarity", F.round("similarity", 6))


@query
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identified(docs, language.train(docs), without=("text", "lang"))
    modulus, left_out = language.HELD_OUT
    return found.select("doc_id", F.coalesce(fold("doc_id", modulus) == left_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transformed(read(spark, sf_dir, "documents").select("doc_id", "text"), without=("text",))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("fim_text")).alias("output_sha256"), digest(infill.restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))
