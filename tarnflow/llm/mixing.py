"""Mixing sources to target weights: Sainte-Laguë seats of equal-token blocks, then seeded selection of blocks.

1. A document's size is its number of white-space separated words; a source's target follows from its weight, with a
   ceiling of ``MOST`` times its own words.
2. Each source's documents, in a seeded order, make a few shards, each a line of words that is cut into blocks of
   ``BLOCK`` words. The whole mix's blocks go to the sources by the highest quotients target / (2k + 1), and each source's
   blocks to its shards by the highest quotients words / (2k + 1).
3. Of a shard's n blocks, q are taken: block j as often as floor((jq + seed) / n) grows at j, a seeded systematic
   selection. Which words of a document are taken (``ranges``) follows from where it lies in the line, so no block is ever
   a row. ``mixed`` writes the mix itself: each document's taken words, as often as they are taken.

Only DataFrame operations. A hot source spreads over shards of about ``SHARD_ROWS`` documents (up to ``MOST_SHARDS``).
Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, the last; repeated
rows each count. Sources without words have target 0. Other columns stay; those with an output name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm.common import checkpointed

#: Weights of the sources in code point order, repeating; share of all words that the mix holds; ceiling per source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK = 16
SHARD_ROWS, MOST_SHARDS = 1000, 4096
SEED = 20
MOST_BROADCAST = 10_000
FIELDS = ("size", "source_size", "target", "taken", "ranges")
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a text that is never null and sorts, as bytes, by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame) -> DataFrame:
    """Of (key, source_size): adds ``target``. A source is at its ceiling from the level of words per weight on at
    which the rest, filled to the same level, holds what is left; the lowest such level is found by running sums over
    the sources in order of ceiling per weight. One small window: a row for each source."""
    by_name = W.orderBy(F.col("key").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    everything = W.partitionBy(F.lit(0))
    rising = W.partitionBy(F.lit(0)).orderBy("level", "weight", "key").rowsBetween(W.unboundedPreceding, -1)
    out = sizes.withColumn("weight", weight).withColumn("ceiling", MOST * F.col("source_size")).withColumn("level", F.col("ceiling") / F.col("weight"))
    out = out.withColumn("total", SHARE * F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    out = out.withColumn("below", F.coalesce(F.sum("ceiling").over(rising), F.lit(0.0))).withColumn("weight_below", F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    out = out.withColumn("fill", (F.col("total") - F.col("below")) / (F.col("weights") - F.col("weight_below")))
    out = out.withColumn("common", F.max(F.when(F.col("fill") <= F.col("level"), F.col("fill"))).over(everything))
    return out.select(*sizes.columns, F.least("ceiling", F.coalesce(F.col("common") * F.col("weight"), F.col("ceiling"))).alias("target"))


def seats(parties: DataFrame, votes: str, to_give: Column, within: list[str], order: list[str]) -> DataFrame:
    """Adds ``seats``: ``to_give`` (equal in all rows of a group) whole seats by the highest quotients votes / (2k + 1).

    Rounding votes / (all votes / seats) misses the number by half a seat a party at most, and the divisor that
    meets it moves each party by its share of that, so only a few quotients a party around that rounding are compared:
    fewer than ten times the number of parties. Ties go by ``order``. Without votes nobody gets a seat."""
    group = W.partitionBy(*within)
    out = parties.withColumns({"_all": F.sum(votes).over(group), "_parties": F.count(F.lit(1)).over(group), "_give": to_give.cast("long")})
    near = F.round(F.try_divide(F.col(votes) * F.col("_give"), F.col("_all"))).cast("long")
    slack = F.ceil(F.try_divide(1.5 * F.col("_parties") * F.col(votes), F.col("_all"))).cast("long") + 2
    out = out.withColumn("_from", F.greatest(F.lit(0).cast("long"), near - slack)).withColumn("_to", near + slack)
    out = out.withColumn("_left", F.col("_give") - F.sum("_from").over(group))
    quotients = out.filter(F.col(votes) > 0).select(*within, *[c for c in order if c not in within], F.col(votes).alias("_votes"), "_left", F.explode(F.sequence(F.col("_from"), F.col("_to"))).alias("_k"))
    best = W.partitionBy(*within).orderBy((F.col("_votes") / (2 * F.col("_k") + 1)).desc(), *order)
    won = quotients.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= F.col("_left"))
    keys = list(dict.fromkeys([*within, *order]))
    joined = out.join(won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won")), keys, "left")
    return joined.select(*parties.columns, F.when(F.col(votes) > 0, F.col("_from") + F.coalesce("_won", F.lit(0))).otherwise(0).cast("long").alias("seats"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """The documents (their columns ``carry``, by default all) with ``size``, ``source_size``, ``target`` (of the source),
    ``ranges`` (which words of it the mix takes: array<struct<start, end, times>>, from 0, end exclusive, neighbours that are
    taken as often as one) and ``taken`` (how many words these are, repeats counted)."""
    names = [c for c in (docs.columns if carry is None else carry) if c not in FIELDS]
    sized = docs.select(
        *(F.col(c).alias(f"_in_{i}") for i, c in enumerate(names)),
        source_key(F.col(source)).alias("key"),
        words(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")).alias("_order"),
        F.xxhash64(F.col(text)).alias("_text"),
    )
    sized = checkpointed(sized)
    whole = W.partitionBy(F.lit(0))
    aims = targets(sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    aims = aims.withColumn("_all_blocks", F.round(F.sum("target").over(whole) / BLOCK).cast("long")).withColumn("_g", F.lit(0))
    aims = seats(aims, "target", F.col("_all_blocks"), ["_g"], ["key"])
    aims = checkpointed(aims.select("key", "source_size", "target", F.col("seats").alias("_blocks"), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("_rows") / SHARD_ROWS)).alias("_shards")))

    # A row for each source: broadcast up to a checked number of them, else joined with skew handling by Spark.
    few = len(aims.limit(MOST_BROADCAST + 1).select(F.lit(1)).collect()) <= MOST_BROADCAST
    placed = sized.join(F.broadcast(aims) if few else aims, "key").withColumn("_shard", F.pmod(F.hash("_order"), F.col("_shards")))
    line = W.partitionBy("key", "_shard").orderBy("_order", "_text", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.withColumn("_end", F.sum("size").over(line))
    shards = placed.groupBy("key", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"))
    shards = seats(shards, "_words", F.col("_blocks"), ["key"], ["_shard"]).withColumn("_n", F.ceil(F.col("_words") / BLOCK))
    shards = shards.select("key", "_shard", "_n", F.least(F.col("seats"), (MOST * F.col("_n")).cast("long")).alias("_q"), F.pmod(F.xxhash64(F.lit(seed), "key", "_shard"), F.greatest("_n", F.lit(1))).alias("_off"))
    out = placed.join(shards, ["key", "_shard"])

    def upto(j: Column) -> Column:
        """Taken blocks before block j."""
        return F.floor(F.try_divide(j * F.col("_q") + F.col("_off"), F.col("_n")))

    begin = F.col("_end") - F.col("size")
    first, last = F.floor(begin / BLOCK), F.floor((F.col("_end") - 1) / BLOCK)
    times = lambda j: upto(j + 1) - upto(j)
    fresh = F.filter(F.sequence(first, last), lambda j: (j == first) | (times(j) != times(j - 1)))

    def spans(at: Column) -> Column:
        """The document's words from one change of ``times`` to the next."""
        whole = F.transform(at, lambda j, i: F.struct(
            (F.greatest(j * BLOCK, begin) - begin).cast("int").alias("start"),
            (F.least(F.coalesce(F.get(at, i + 1), last + 1) * BLOCK, F.col("_end")) - begin).cast("int").alias("end"),
            times(j).cast("int").alias("times"),
        ))
        return F.filter(whole, lambda s: s["times"] > 0)

    none = F.array().cast("array<struct<start:int,end:int,times:int>>")
    ranges = F.when((F.col("size") > 0) & (F.col("_q") > 0), F.element_at(F.transform(F.array(fresh), spans), 1)).otherwise(none)
    out = out.select(*(c for c in out.columns if c.startswith("_in_")), "size", "source_size", "target", ranges.alias("ranges"))
    taken = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]) * s["times"])
    return out.select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)), "size", "source_size", "target", taken.alias("taken"), "ranges")


def mixed(docs: DataFrame, text: str = "text", **options: str | int) -> DataFrame:
    """The mix: the documents as ``mix`` gives them, their text now the words that are taken, joined by spaces, each range as
    often as it is taken; empty where nothing is."""
    out = mix(docs, text, **options)
    words_ = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))

    def taken(held: Column) -> Column:
        piece = lambda s: F.array_repeat(F.array_join(F.slice(held, s["start"] + 1, s["end"] - s["start"]), " "), s["times"])
        return F.array_join(F.flatten(F.transform("ranges", piece)), " ")

    # The words are made once, not once for each range.
    return out.withColumn(text, F.when(F.col("taken") > 0, F.element_at(F.transform(F.array(words_), taken), 1)).otherwise(F.lit("")))
