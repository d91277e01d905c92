"""Personal data: fixed patterns, and boosted trees over spans that high-recall generators propose.

Generators propose overlapping spans of each kind (a card inside a longer run of digits, a phone number that runs into
another number, an address with a spelt-out at sign). Format and context of a span make a few small whole numbers
(``FEATURES``), so all spans of a corpus are a histogram of at most ``MOST_CELLS`` cells, however many rows there are: one
DataFrame aggregate over every text. Gradient-boosted trees of depth two are fitted to the histogram, with the fixed
patterns' verdicts as labels; a span that only differs from a fixed match by its ends is not labelled, it is what the trees
are for. Each kind's threshold is the lowest score from which on the calibration fold's spans are right in ``PRECISION`` of
cases; a kind without such a score adds nothing. Scoring is a Spark expression over the trees.

Everything is a Spark column; no Python runs on the executors and only the histogram is shuffled. Nulls and empty texts have
no spans; rows may repeat. Other columns pass through; those with an output name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import spans as S
from tarnflow.llm.common import fold

# The patterns of the base scan, in order. Possessive and begun at the start of a run (or where the match
# before ended), they find what the plain ones find, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@|[\\[(]at[\\])]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
PROPOSED = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++",),
    "ip": (r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",),
    "card": (r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{1,7}(?![0-9])", r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"),
    "phone": (r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
#: Names and numbers of values of a span's features.
FEATURES = {"kind": 4, "valid": 2, "digits": 6, "separators": 4, "before": 4, "after": 4, "named": 2, "plus": 2}
MOST_CELLS = math.prod(FEATURES.values())
_NAMES = r"(?i)(e-?mail|mail|contact|write to|ip|address|host|card|visa|credit|payment|phone|tel|call|mobile|fax)\W{0,3}$"
ROUNDS, RATE, RIDGE = 30, 0.4, 1.0
PRECISION = 0.95
CALIBRATION = (5, 0)


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        d = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + d

    return F.when(F.length(digits) == 0, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0)


def passes(kind: str, found: Column) -> Column:
    """Whether a match of the fixed pattern counts."""
    n = F.length(digits_of(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(found))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _level(x: Column, *bounds: int) -> Column:
    """Number of bounds that x reaches."""
    return sum(((x >= b).cast("int") for b in bounds), F.lit(0))


def _neighbour(ch: Column) -> Column:
    return F.when(ch == "", 0).when(ch.rlike("[0-9]"), 1).when(ch.rlike(r"^\s$"), 2).otherwise(3)


def _features(kind: str, body: Column) -> Callable[[Column], Column]:
    def of(s: Column) -> Column:
        found, n = s["found"], F.length(digits_of(s["found"]))
        valid = found.rlike(r"[A-Za-z]{2,}$") if kind == "email" else n.between(9, 15) & (F.length(found) <= 24) if kind == "phone" else passes(kind, found)
        ahead = F.when(s["start"] == 0, F.lit("")).otherwise(F.substring(body, s["start"], F.lit(1)))
        context = F.substring(body, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            valid.cast("int").alias("valid"),
            _level(n, 1, 9, 12, 16, 17).alias("digits"),
            _level(F.length(found) - F.length(F.regexp_replace(found, r"[\x20().@\[\]-]", "")), 1, 3, 4).alias("separators"),
            _neighbour(ahead).alias("before"),
            _neighbour(F.substring(body, s["end"] + 1, F.lit(1))).alias("after"),
            context.rlike(_NAMES).cast("int").alias("named"),
            found.startswith("+").cast("int").alias("plus"),
        )

    return of


def _kind_order(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind_order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _spotted(docs: DataFrame, text: str) -> DataFrame:
    """Adds _raw_<kind> (matches of the fixed patterns), <kind> (those that count) and _proposed (spans with features)."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    raw, counted, proposed = {}, {}, []
    for kind in KINDS:
        there = body.rlike(NEEDS[kind])
        raw[f"_raw_{kind}"] = F.when(there, S.matches(body, BASE[kind])).otherwise(none)
        counted[kind] = F.transform(F.filter(f"_raw_{kind}", _counts(kind)), _kind_order(kind))
        for pattern in PROPOSED[kind]:
            proposed.append(F.when(there, F.transform(S.matches(body, pattern), _features(kind, body))))
    out = docs.withColumns(raw).withColumns(counted)
    return out.withColumn("_proposed", F.flatten(F.array_compact(F.array(*proposed))))


def _counts(kind: str) -> Callable[[Column], Column]:
    return lambda s: passes(kind, s["found"])


@dataclass
class Model:
    #: Of each tree: (feature, value, (feature, value, leaf, leaf), (feature, value, leaf, leaf)); a test is feature <= value.
    trees: list[tuple[str, int, tuple[str, int, float, float], tuple[str, int, float, float]]]
    start: float
    #: Least score of each kind; infinite: nothing is added.
    thresholds: dict[str, float]

    def score(self, x: dict[str, int]) -> float:
        total = self.start
        for f, v, low, high in self.trees:
            g, w, a, b = low if x[f] <= v else high
            total += a if x[g] <= w else b
        return total

    def column(self, s: Column) -> Column:
        total = F.lit(self.start)
        for f, v, low, high in self.trees:
            low, high = (F.when(s[g] <= w, F.lit(a)).otherwise(F.lit(b)) for g, w, a, b in (low, high))
            total = total + F.when(s[f] <= v, low).otherwise(high)
        return total


def _best_split(cells: list[tuple[dict[str, int], float, float]]) -> tuple[float, str, int]:
    """(gain, feature, value) of the test feature <= value that gains most, over (features, gradient, hessian)."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (0.0, "kind", len(KINDS))
    for f, size in FEATURES.items():
        sums = [[0.0, 0.0] for _ in range(size)]
        for x, a, b in cells:
            sums[x[f]][0] += a
            sums[x[f]][1] += b
        left_g = left_h = 0.0
        for v in range(size - 1):
            left_g, left_h = left_g + sums[v][0], left_h + sums[v][1]
            gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
            if gain > best[0] + 1e-9:
                best = (gain, f, v)
    return best


def fit(cells: list[tuple[dict[str, int], bool, int, int]]) -> Model:
    """Boosts on (features, calibration fold?, spans, spans that are right)."""
    learn = [(x, n, p) for x, held, n, p in cells if not held]
    n, p = sum(c[1] for c in learn), sum(c[2] for c in learn)
    model = Model([], math.log((p + 0.5) / (n - p + 0.5)), dict.fromkeys(KINDS, math.inf))
    for _ in range(ROUNDS if learn else 0):
        stepped = []
        for x, n, p in learn:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.score(x)))))
            stepped.append((x, p - n * q, max(n * q * (1 - q), 1e-9)))
        _, f, v = _best_split(stepped)
        sides = []
        for side in ([c for c in stepped if c[0][f] <= v], [c for c in stepped if c[0][f] > v]):
            _, g, w = _best_split(side)
            leaves = [[c for c in side if (c[0][g] <= w) == low] for low in (True, False)]
            sides.append((g, w, *(RATE * sum(c[1] for c in leaf) / (sum(c[2] for c in leaf) + RIDGE) for leaf in leaves)))
        model.trees.append((f, v, sides[0], sides[1]))
    for k, kind in enumerate(KINDS):
        held = sorted(((model.score(x), n, p) for x, h, n, p in cells if h and x["kind"] == k), reverse=True)
        n = p = 0
        for i, (score, cell_n, cell_p) in enumerate(held):
            n, p = n + cell_n, p + cell_p
            if (i + 1 == len(held) or held[i + 1][0] < score) and p >= PRECISION * n:
                model.thresholds[kind] = score - 1e-9
    return model


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    modulus, held = CALIBRATION
    spotted = _spotted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    taught = []
    for k, kind in enumerate(KINDS):
        right = F.exists(kind, lambda b: (b["start"] == F.col("_s")["start"]) & (b["end"] == F.col("_s")["end"]))
        # Inside a counted match a shorter span is wrong; inside one that doesn't count it is open.
        inside = lambda where: F.exists(where, lambda r: (r["start"] <= F.col("_s")["start"]) & (F.col("_s")["end"] <= r["end"]) & (r["end"] - r["start"] != F.col("_s")["end"] - F.col("_s")["start"]))
        cut = inside(f"_raw_{kind}") & ~inside(kind)
        taught.append(F.when((F.col("_s")["kind"] == k) & ~cut, right.cast("int")))
    spans = spotted.select(F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held"), *KINDS, *(f"_raw_{k}" for k in KINDS), F.explode("_proposed").alias("_s"))
    spans = spans.withColumn("right", F.coalesce(*taught)).filter(F.col("right").isNotNull())
    cells = spans.groupBy("held", *(F.col("_s")[f].alias(f"f_{f}") for f in FEATURES)).agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("p"))
    # At most 2 * MOST_CELLS rows, however many spans there are.
    rows = sorted(cells.collect(), key=lambda r: tuple(r))
    return fit([({f: r[f"f_{f}"] for f in FEATURES}, r["held"], r["n"], r["p"]) for r in rows])


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``email``, ``ip``, ``card``, ``phone`` (arrays of struct<kind_order, start, end, kind>, code points, end exclusive),
    ``base`` (all of them by kind, then start) and ``pii_spans`` (with what the trees add; no added span touches one of its kind)."""
    names = [*KINDS, "base", "pii_spans", "_proposed", *(f"_raw_{k}" for k in KINDS)]
    out = _spotted(docs.drop(*(n for n in names if n != text)), text).drop(*(f"_raw_{k}" for k in KINDS))
    out = out.withColumn("base", F.array_sort(F.concat(*KINDS)))

    def selected(s: Column) -> Column:
        need = F.lit(math.inf)
        for k, kind in enumerate(KINDS):
            need = F.when(s["kind"] == k, F.lit(model.thresholds[kind])).otherwise(need)
        taken = F.exists("base", lambda b: (b["kind_order"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (need < math.inf) & ~taken & (model.column(s) >= need)

    kinds = F.array(*map(F.lit, KINDS))
    more = F.transform(F.filter("_proposed", selected), lambda s: F.struct(s["kind"].alias("kind_order"), s["start"].alias("start"), s["end"].alias("end"), F.element_at(kinds, s["kind"] + 1).alias("kind")))
    return out.withColumn("pii_spans", F.array_sort(F.array_distinct(F.concat("base", more)))).drop("_proposed")
