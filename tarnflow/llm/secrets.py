"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is a Spark column; no Python runs on the executors and no row is shuffled.
Nulls and empty texts have no spans; rows may repeat; other columns of the input pass through
``scan`` untouched unless they carry the name of an output column, which then replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import spans as S

#: The kinds of the base scan, in order, with pattern, group and least length of the group.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The runs of the other two are maximal, so the least length can stand in the pattern.
BASE = (("assign", ASSIGN, 1, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))

#: Candidates of the entropy scan, and the characters of a window.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
_PIECE = 256
#: Character classes, the first that fits counts: pattern of the whole candidate and bits per character that a window must reach.
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("mixed", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 3.7), ("alphanumeric", r"^(?=.*[0-9])(?=.*[A-Za-z])", 3.5))
#: Candidates that are no secrets: placeholders, alphabets, UUIDs and digests of nothing.
ALLOWED = (
    r"(?i)example|placeholder|changeme|dummy|sample|lorem",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
)


def window_entropy(token: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits per character) of a window of ``width`` characters of a token.

    Holds S = sum of c log2 c over the counts c of a window. A step drops the character that leaves and adds the one
    that enters, each changing S by its own count alone; entropy is log2(width) - S / width. Tokens shorter than a window: null."""
    weight = lambda c: F.when(c <= 1, F.lit(0.0)).otherwise(c * F.log2(c.cast("double")))
    count = lambda where, ch: F.length(where) - F.length(F.replace(where, ch, F.lit("")))

    def step(acc: Column, j: Column) -> Column:
        first = F.greatest(j - width, F.lit(1))
        held = F.substring(token, first, j - first)
        leaves, enters = F.substring(token, first, F.lit(1)), F.substring(token, j, F.lit(1))
        out = count(held, leaves)
        full = j > width
        s = acc["s"] - F.when(full, weight(out) - weight(out - 1)).otherwise(F.lit(0.0))
        rest = F.when(full, F.substring(held, F.lit(2), F.lit(width))).otherwise(held)
        now = count(rest, enters)
        s = s + weight(now + 1) - weight(now)
        return F.struct(s.alias("s"), F.when(j >= width, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"))

    begin = F.struct(F.lit(0.0).alias("s"), F.lit(float("inf")).alias("least"))
    least = F.aggregate(F.sequence(F.lit(1), F.length(token)), begin, step, lambda acc: acc["least"])
    return F.when(F.length(token) >= width, F.lit(math.log2(width)) - least / width)


def most_entropy(token: Column, width: int = WINDOW) -> Column:
    """``window_entropy`` of a token of any length: over pieces that share width - 1 characters, so that every window
    lies in one and finding a character's place in a long token doesn't take the square of its length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(token) - width + 1, F.lit(1)), F.lit(_PIECE))
    return F.array_max(F.transform(starts, lambda at: S.let(F.substring(token, at, F.lit(_PIECE + width - 1)), lambda piece: window_entropy(piece, width))))


def suspicious(token: Column) -> Column:
    """Whether a candidate's class asks for no more entropy than its best window has, and no allow-list entry fits."""
    need = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        need = F.when(token.rlike(pattern), F.lit(bits)).otherwise(need)
    fits = F.lit(False)
    for pattern in ALLOWED:
        fits = fits | token.rlike(pattern)
    return F.coalesce(F.when(need.isNull() | fits, F.lit(False)).otherwise(most_entropy(token) >= need), F.lit(False))


def _of_length(least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(s["found"]) >= least


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``assign``, ``access`` and ``hex`` (arrays of struct<start, kind_order, end, kind>, code points, end exclusive),
    ``base`` (all of them by start, then kind) and ``secret_spans`` (base and entropy spans; an entropy span inside a base span is left out)."""
    names = [kind for kind, *_ in BASE] + ["base", "secret_spans", "_candidates"]
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(*(n for n in names if n != text)).withColumns(
        {kind: S.of_kind(F.filter(S.matches(body, pattern, group), _of_length(least)), kind, k) for k, (kind, pattern, group, least) in enumerate(BASE)}
        | {"_candidates": F.filter(S.matches(body, CANDIDATE), lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))}
    )
    out = out.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    entropic = F.filter("_candidates", lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])) & suspicious(c["found"]))
    return out.withColumn("secret_spans", F.array_sort(F.concat("base", S.of_kind(entropic, "entropy", len(BASE))))).drop("_candidates")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replaces every secret span of ``text`` by ``mask``; overlapping spans get one mask. All other columns stay.

    A single pass over the spans by start: what lies before a span and after everything masked so far is kept."""
    spanned = scan(docs.withColumnRenamed(text, "_text"), "_text").drop(*(k for k, *_ in BASE), "base")
    body = F.coalesce(F.col("_text"), F.lit(""))
    merged = F.aggregate(
        "secret_spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    spanned = spanned.withColumn("_merged", F.when(F.size("secret_spans") > 0, merged))
    pieces = F.transform("_merged", lambda s, i: F.substring(body, F.when(i == 0, 1).otherwise(F.element_at(F.col("_merged"), F.greatest(i, F.lit(1)))["end"] + 1), s["start"] - F.when(i == 0, 0).otherwise(F.element_at(F.col("_merged"), F.greatest(i, F.lit(1)))["end"])))
    rest = F.substring(body, F.element_at(F.col("_merged"), F.lit(-1))["end"] + 1, F.length(body))
    clean = F.when(F.size("secret_spans") > 0, F.concat(F.array_join(pieces, mask), F.lit(mask), rest)).otherwise(F.col("_text"))
    order = [c for c in docs.columns if c != text]
    return spanned.select(*(F.col(c) for c in order if c in spanned.columns), clean.alias(text)).select(*docs.columns)
