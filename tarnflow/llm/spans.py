"""Spans of regular-expression matches as Spark columns, in code points, without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose lengths are added up together; keeps running sums near linear in their number.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda would compute what it captures again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array of integers: within blocks, then over the blocks."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    sums = lambda part: F.transform(part, lambda _, i: total(F.slice(part, F.lit(1), i + 1)))

    def blocks(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))
        return let(parts, lambda ps: let(sums(F.transform(ps, total)), lambda ends: F.flatten(F.zip_with(F.transform(ps, sums), F.zip_with(ends, F.transform(ps, total), lambda e, t: e - t), lambda p, before: F.transform(p, lambda x: x + before)))))

    return let(lengths, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(blocks(xs)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern that matches no empty string:
    array<struct<start int, end int, found string>>, where found is the given group.

    A match starts after all gaps and matches before it, so the pieces between matches give the positions."""

    def spans(whole: Column) -> Column:
        gaps = F.split(text, F.lit(pattern), F.lit(-1))
        steps = F.slice(F.zip_with(gaps, F.concat(F.array(F.lit("")), whole), lambda g, m: F.length(g) + F.length(m)), F.lit(1), F.size(whole))
        at = F.zip_with(_running_sums(steps), whole, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found")))
        return at if group == 0 else F.zip_with(at, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s, f: F.struct(s["start"].alias("start"), s["end"].alias("end"), f.alias("found")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def of_kind(spans: Column, kind: str, order: int) -> Column:
    """Spans as struct<start, kind_order, end, kind>, which sorts by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
