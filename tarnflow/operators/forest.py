"""Trees over tables: bottleneck spanning forests, merge trees, Euler tours, subtree sums and minima, blocks and bridges.

No step follows a tree edge by edge: a forest takes rounds that halve the components, tours and look-ups take rounds that
double a step, whatever the depth. Every round's table is checkpointed and none is collected; a node with very many edges
costs partial aggregates and joins whose other side has one row a node. Nodes are longs; edges with a null end and
loops are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.operators.components import connected_components
from tarnflow.operators.order import ranked, running
from tarnflow.operators.session import round_of

#: Edges of a forest, neighbours in order, that one task merges one by one.
BLOCK = 1 << 15
#: Places of a tour whose minima one task looks at one by one.
SPAN = 1 << 10
#: The same where every place may be asked for many times: a row looks at so many.
NEAR = 1 << 5
#: Rows of a map from component to component, counted first, up to which it is broadcast.
FEW = 20_000
#: Links a node, about, that the first rounds of a forest take: so many that few nodes stay out of the large components.
LIGHT = 4
#: Links that a task thins at once, and of a range's forest that it holds.
THINNED = 1 << 20
#: Links of a range that aren't worth it.
FEW_LINKS = 1 << 15


def _upward(edges: DataFrame, weight: str | None) -> DataFrame:
    """Links with a weight as (u, v, w), u < v."""
    w = F.lit(0) if weight is None else F.col(weight)
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), w.alias("w"), (F.col("u") != F.col("v")).alias("_ok"))
    return e.filter(F.col("_ok") & F.col("w").isNotNull()).drop("_ok")


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u", "v").agg(F.min("w").alias("w"))


def simple(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Each link once, u < v, with the least of its weights as ``w`` (without a weight: 0)."""
    return _least(_upward(edges, weight))


def _in_forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which links are in the spanning forest of the first ones, by Borůvka's rounds."""
    n = len(u)
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, own = at[:n], at[n:], np.arange(len(ids))
    live, taken = np.arange(n), np.zeros(n, bool)
    while len(live):
        best = np.full(len(ids), n)
        np.minimum.at(best, a[live], live)
        np.minimum.at(best, b[live], live)
        out = np.flatnonzero(best < n)
        link = best[out]
        taken[link] = True
        up = own.copy()
        up[out] = a[link] + b[link] - out
        up = np.where((up[up] == own) & (own < up), own, up)
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        live = live[a[live] != b[live]]
    return taken


def thinned(links: DataFrame) -> DataFrame:
    """Links (u, v, w) without those that close a cycle of links before them, in the order (w, u, v), in their range of (u, v). The
    forest of all links has none of these. Where numbers that are near share links, little more than a forest is left; elsewhere
    few are lost. A task holds ``THINNED`` links and a forest of as many; a larger forest is given out, and the next one begun."""

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        fresh = 0

        def cut() -> pa.Table:
            table = pa.Table.from_batches(held)
            return table.filter(pa.array(_in_forest(table["u"].to_numpy(), table["v"].to_numpy())))

        for batch in batches:
            held.append(batch)
            fresh += batch.num_rows
            if fresh >= THINNED:
                kept = cut()
                held, fresh = kept.to_batches(), 0
                if len(kept) >= THINNED:
                    yield from held
                    held = []
        if held:
            yield from cut().to_batches() if sum(b.num_rows for b in held) > FEW_LINKS else held

    return links.repartitionByRange("u", "v").sortWithinPartitions("w", "u", "v").mapInArrow(forests, links.schema)


def followed(pointers: DataFrame) -> DataFrame:
    """(node, end): where chains of pointers (node, to) end: a node that points to itself, or isn't there. Steps double."""
    at = round_of(pointers.select("node", F.col("to").alias("end")))
    few = at.count() <= FEW
    while True:
        on = at.select(F.col("node").alias("_n"), F.col("end").alias("_e"))
        further = round_of(at.join(F.broadcast(on) if few else on, F.col("end") == F.col("_n"), "left").select("node", F.col("end").alias("was"), F.coalesce("_e", "end").alias("end")))
        moved = not further.filter("was <> end").isEmpty()
        at = further.select("node", "end")
        if not moved:
            return at


def _rounds(e: DataFrame, found: list[DataFrame]) -> DataFrame | None:
    """Borůvka's rounds over links (a, b, link) between components, until none leads out of one. Adds what they take to ``found``;
    gives (node, end), each component and the one it is in at last."""
    names: DataFrame | None = None
    while not e.isEmpty():
        out = e.select("a", "b", "link").union(e.select(F.col("b"), F.col("a"), "link"))
        best = round_of(out.groupBy("a").agg(F.min(F.struct("link", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.link").alias("link")))
        found.append(best.select("link").distinct())
        back = best.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        mutual = (F.col("_b") == F.col("a")) & (F.col("a") < F.col("b"))
        ends = followed(best.join(back, F.col("b") == F.col("_a"), "left").select(F.col("a").alias("node"), F.when(mutual, F.col("a")).otherwise(F.col("b")).alias("to")))
        few = ends.count() <= FEW
        m = ends.select(F.col("node").alias("_n"), F.col("end").alias("_e"))
        m = F.broadcast(m) if few else m
        for side in ("a", "b"):
            e = e.join(m, F.col(side) == F.col("_n")).withColumn(side, F.col("_e")).drop("_n", "_e")
        e = e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "link")
        e = round_of(e.groupBy("a", "b").agg(F.min("link").alias("link")))
        names = ends if names is None else round_of(names.join(m, F.col("end") == F.col("_n"), "left").select("node", F.coalesce("_e", "end").alias("end")))
    return names


def _light(e: DataFrame) -> Column | None:
    """Whether a link (u, v, w) is among the lightest, about ``LIGHT`` a node; None where that isn't a small part of all. Only weights
    are compared, so of equal ones all are light or none is."""
    kind, w = e.schema["w"].dataType, F.col("w")
    if isinstance(kind, T.StructType):
        kind, w = kind[0].dataType, F.col(f"w.{kind[0].name}")
    if not isinstance(kind, T.NumericType):
        return None
    parts = [2.0**-k for k in range(1, 11)]
    n, u, v, at = e.agg(F.count(F.lit(1)), F.approx_count_distinct("u"), F.approx_count_distinct("v"), F.percentile_approx(w, parts, 10000)).first()
    enough = [x for part, x in zip(parts, at or [], strict=False) if part * n >= LIGHT * (u + v)]
    return F.coalesce(w <= F.lit(enough[-1]), F.lit(True)) if enough else None  # a struct's null comes before all


def bottleneck_forest(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(u, v, w): the spanning forest of least weight, by Borůvka's rounds. Links are in the strict order (w, u, v), so there is
    one such forest; the largest weight on its way between two nodes is the least that any way has.

    A round takes the first link out of every component. These links form trees with one link chosen from both sides each:
    its smaller end is where the pointers of the tree lead, which names the new component. Where there are many links a node,
    rounds over the lightest come first: most of the rest then lie inside a component, and are dropped in one pass. Before, the
    links of each range are thinned, so that no more than one shuffle sees them all."""
    e = round_of(_least(thinned(_upward(edges, weight))))
    found: list[DataFrame] = []
    link = F.struct("w", "u", "v").alias("link")
    light = _light(e)
    if light is None:
        _rounds(e.select(F.col("u").alias("a"), F.col("v").alias("b"), link), found)
    else:
        names = _rounds(round_of(e.filter(light).select(F.col("u").alias("a"), F.col("v").alias("b"), link)), found)
        rest = e.filter(~light)
        for side, end in (("u", "a"), ("v", "b")):
            m = names.select(F.col("node").alias("_n"), F.col("end").alias("_e"))
            rest = rest.join(m, F.col(side) == F.col("_n"), "left").withColumn(end, F.coalesce("_e", side)).drop("_n", "_e")
        rest = rest.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), link)
        _rounds(round_of(rest.groupBy("a", "b").agg(F.min("link").alias("link"))), found)
    if not found:
        return e.select("u", "v", "w")
    return reduce(DataFrame.union, found).select("link.u", "link.v", "link.w")


def watershed(nodes: DataFrame, edges: DataFrame, weight: str = "w") -> DataFrame:
    """(node, label): spreads the markers of some nodes (node, marker or null) over links, the lightest first; null where no marker
    comes. The forest that has all markers as one node from the start is cut there: each tree holds the nodes of one label.

    This is what flooding from the markers gives, with a link's weight the height at which it is passed."""
    m = nodes.filter(F.col("marker").isNotNull()).select(F.col("node").alias("_n"), F.lit(True).alias("_m"))
    e = simple(edges, weight)
    for side in ("u", "v"):
        e = e.join(m, F.col(side) == F.col("_n"), "left").withColumn(f"{side}m", F.coalesce("_m", F.lit(False))).drop("_n", "_m")
    # One node stands for all markers; which link reaches it is remembered in the weight.
    ocean = F.lit(-(1 << 62)).cast("long")
    way = F.struct("w", "u", "v")
    joined = e.filter(~(F.col("um") & F.col("vm"))).select(F.when(F.col("um"), ocean).otherwise(F.col("u")).alias("u"), F.when(F.col("vm"), ocean).otherwise(F.col("v")).alias("v"), way.alias("w"))
    kept = bottleneck_forest(joined).select(F.col("w.u").alias("src"), F.col("w.v").alias("dst"))
    cc = connected_components(kept)
    named = nodes.filter(F.col("marker").isNotNull()).select("node", "marker").join(cc, "node").select("component", "marker")
    spread = cc.join(named, "component").select(F.col("node").alias("_n"), F.col("marker").alias("_label"))
    return nodes.join(spread, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("marker", "_label").alias("label"))


# ---- merge trees


def merges(forest: DataFrame, block: int = BLOCK) -> DataFrame:
    """(place, w, node, up): links of a forest in order, each as the component named ``node`` that goes up in the one named
    ``up`` at level ``w``; a component is named by its smallest node, so every node but a tree's smallest goes up once.

    Halving by rank: a part of the order knows the components as they are where it begins; its second half learns them from the
    components of its first half's links. Every link is in one part, so a level costs one pass; parts of ``block``
    links are merged one by one."""
    rows = ranked(forest, ["w", "u", "v"]).select("place", "w", F.col("u").alias("a"), F.col("v").alias("b"), F.expr(f"place div {block}").alias("part"))
    rows = round_of(rows)
    most = rows.agg(F.max("part")).first()[0] or 0
    for bit in reversed(range(int(most).bit_length())):
        second = F.shiftright("part", bit).bitwiseAND(1) == 1
        group = F.shiftright("part", bit + 1)
        key = lambda c: F.struct(group.alias("g"), F.col(c).alias("n"))  # noqa: B023, E731
        cc = connected_components(rows.filter(~second).select(key("a").alias("src"), key("b").alias("dst")))
        names = round_of(cc.select(F.col("node.g").alias("_g"), F.col("node.n").alias("_n"), F.col("component.n").alias("_c")))
        later = rows.filter(second).withColumn("_group", group)
        for side in ("a", "b"):
            later = later.join(names, (F.col("_group") == F.col("_g")) & (F.col(side) == F.col("_n")), "left").withColumn(side, F.coalesce("_c", side)).drop("_g", "_n", "_c")
        rows = round_of(rows.filter(~second).union(later.drop("_group")))

    def one_by_one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", ignore_index=True)
        name: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := name.get(x, x)) != x:
                name[x] = name.get(y, y)
                x = y
            return x

        went, up = [], []
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            a, b = sorted((root(a), root(b)))
            name[b] = a
            went.append(b)
            up.append(a)
        return pd.DataFrame({"place": part["place"], "w": part["w"], "node": went, "up": up})

    kind = forest.schema["w"].dataType.simpleString()
    return rows.groupBy("part").applyInPandas(one_by_one, f"place long, w {kind}, node long, up long")


class MergeTree:
    """Look-up tables over the merges of a forest: of each node, where 1, 2, 4 … steps up lead, and the level of the last one.
    Levels rise on the way up, so a component at a level is found by steps of a quarter: those who ask pass once for two lengths of steps."""

    def __init__(self, tree: DataFrame) -> None:
        step = round_of(tree.select("node", "up", "w", F.lit(1).cast("long").alias("steps")))
        self.steps: list[DataFrame] = []
        while not step.isEmpty():
            self.steps.append(step)
            on = step.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("w").alias("_w"))
            step = round_of(step.join(on, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up"), F.col("_w").alias("w"), (2 * F.col("steps")).alias("steps")))

    def _three(self, k: int) -> DataFrame:
        """Where 2^k steps lead from a node, once, twice and three times, and the levels of the last ones."""
        step = lambda k, i: self.steps[k].select(F.col("node").alias(f"_n{i}"), F.col("up").alias(f"_u{i}"), F.col("w").alias(f"_w{i}"))
        once = step(k, 1).withColumnRenamed("_n1", "_n")
        if k + 1 == len(self.steps):  # no node has two such steps above it
            return once
        return once.join(step(k + 1, 2), F.col("_n") == F.col("_n2"), "left").join(step(k, 3), F.col("_u2") == F.col("_n3"), "left").drop("_n2", "_n3")

    def component_at(self, asked: DataFrame, node: str, level: str, name: str = "component") -> DataFrame:
        """Adds the smallest node that a node is joined with over links of at most a level."""
        out = asked.withColumn(name, F.col(node))
        for k in reversed(range(0, len(self.steps), 2)):
            ways = self._three(k)
            out = out.join(ways, F.col(name) == F.col("_n"), "left")
            higher = F.coalesce(*(F.when(F.col(f"_w{i}") <= F.col(level), F.col(f"_u{i}")) for i in (3, 2, 1) if f"_u{i}" in ways.columns), name)
            out = round_of(out.withColumn(name, higher).select(*asked.columns, name))
        return out

    def places(self) -> DataFrame:
        """(node, root, at, w): nodes in a row in which, at any level, each component is a run that begins with its name: a node,
        then what has come up in it, the lowest level first. Trees follow one another; ``w`` is the level at which a node goes up."""
        if not self.steps:
            raise ValueError("no merges")
        ups = self.steps[0].select("node", "up", "w")
        one = F.lit(1).cast("long")
        size = round_of(ups.select("node").union(ups.select("up")).distinct().withColumn("n", one))
        for step in self.steps:  # those fewer than 1, 2, 4 … steps below
            more = step.select(F.col("node"), "up").join(size, "node").groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("m"))
            size = round_of(size.join(more, "node", "left").select("node", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))
        kids = running(ups.join(size, "node"), ["w", "node"], F.col("n"), "upto", ["up"])
        at = round_of(kids.select("node", F.col("up").alias("root"), (F.col("upto") - F.col("n") + 1).alias("at"), "w"))
        for _ in self.steps:
            on = at.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("at").alias("_a"))
            at = round_of(at.join(on, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), (F.col("at") + F.coalesce("_a", F.lit(0))).alias("at"), "w"))
        tops = running(size.join(ups, "node", "left_anti"), ["node"], F.col("n"), "upto").select(F.col("node").alias("root"), (F.col("upto") - F.col("n")).alias("before"))
        tops = round_of(tops)
        below = at.join(tops, "root").select("node", "root", (F.col("before") + F.col("at")).alias("at"), "w")
        return below.union(tops.select("root", "root", "before", F.lit(None).cast(ups.schema["w"].dataType)))

    def joined_at(self, pairs: DataFrame, a: str, b: str, name: str = "level") -> DataFrame:
        """Adds the level at which two nodes become one component: the highest one at which any node between their places, the
        later one included, goes up. Null for nodes that never meet, and for a node with itself."""
        if not self.steps:
            return pairs.withColumn(name, F.lit(None).cast("double"))
        p, out = round_of(self.places()), pairs
        for side, n in ((a, "1"), (b, "2")):
            t = p.select(F.col("node").alias("_n"), F.col("root").alias(f"_r{n}"), F.col("at").alias(f"_p{n}"))
            out = out.join(t, F.col(side) == F.col("_n"), "left").drop("_n")
        out = round_of(out)
        meet = F.coalesce((F.col("_r1") == F.col("_r2")) & (F.col("_p1") != F.col("_p2")), F.lit(False))
        asked = out.filter(meet).select(*pairs.columns, (F.least("_p1", "_p2") + 1).alias("first"), F.greatest("_p1", "_p2").alias("last"))
        got = range_extremes(p.select(F.col("at").alias("place"), F.col("w").alias("low"), F.col("w").alias("high")), asked, NEAR)
        none = F.lit(None).cast(p.schema["w"].dataType).alias(name)
        return got.select(*pairs.columns, F.col("most").alias(name)).union(out.filter(~meet).select(*pairs.columns, none))


# ---- tours


def list_ranks(items: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(id, last, *sums): of items (id, next, *sums) of linked lists, each list's last item, and the sums from an item to the end,
    itself included. Steps double each round; items that have come to the end leave the join."""
    state = round_of(items.select("id", "next", F.col("id").alias("last"), *sums))
    while not state.filter(F.col("next").isNotNull()).isEmpty():
        on = state.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("last").alias("_last"), *(F.col(c).alias(f"_{c}") for c in sums))
        moved = state.filter(F.col("next").isNotNull()).join(on, F.col("next") == F.col("_id"))
        moved = moved.select("id", F.col("_next").alias("next"), F.col("_last").alias("last"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums))
        state = round_of(state.filter(F.col("next").isNull()).union(moved))
    return state.drop("next")


def rooted(forest: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, parent): a forest of links (u, v) hung up at the given nodes, one a tree (default: a tree's smallest); roots have no
    parent. An arc is followed by the next one out of where it leads; the list so made is cut at the root, and of a link's two
    arcs the one that comes first leads down."""
    if roots is None:
        roots = connected_components(forest, "u", "v").select(F.col("component").alias("node")).distinct()
    roots = round_of(roots.select("node").distinct())
    arcs = ranked(forest.select("u", "v").union(forest.select("v", "u")), ["u", "v"])
    firsts = arcs.groupBy("u").agg(F.min("place").alias("first"), F.max("place").alias("end"))
    firsts = firsts.join(roots.select(F.col("node").alias("u"), F.lit(True).alias("root")), "u", "left")
    turned = arcs.join(firsts, "u").select("u", "v", "place", F.when(F.col("place") < F.col("end"), F.col("place") + 1).when(F.col("root").isNull(), F.col("first")).alias("succ"))
    turned = round_of(turned)
    back = turned.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("succ").alias("next"))
    ranks = list_ranks(turned.join(back, ["u", "v"]).select(F.col("place").alias("id"), "next", F.lit(1).cast("long").alias("n")), ["n"])
    placed = turned.select("u", "v", F.col("place").alias("id")).join(ranks, "id").select("u", "v", "n")
    other = placed.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("n").alias("m"))
    down = placed.join(other, ["u", "v"]).filter("n > m").select(F.col("v").alias("node"), F.col("u").alias("parent"))
    return down.union(roots.join(firsts.select(F.col("u").alias("node")), "node", "left_semi").select("node", F.lit(None).cast("long").alias("parent")))


def tour(parents: DataFrame, value: str | None = None) -> DataFrame:
    """(node, parent, root, enter, leave, depth, size, total): the Euler tour of a forest (node, parent or null): a node's subtree
    takes the places enter … leave of one row over all trees, size counts its nodes and total sums their ``value``
    (exact for whole numbers and decimals)."""
    v = F.lit(0).cast("long") if value is None else F.col(value)
    rows = round_of(ranked(parents.select("node", "parent", v.alias("value")), [F.col("parent").asc_nulls_first(), "node"], "at"))
    after = rows.select((F.col("at") - 1).alias("at"), F.col("parent").alias("_p"), F.col("at").alias("sibling"))
    kids = rows.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.min("at").alias("child"))
    up = rows.select(F.col("node").alias("parent"), F.col("at").alias("parent_at"))
    named = rows.join(after, "at", "left").join(kids, "node", "left").join(up, "parent", "left")
    named = round_of(named.withColumn("sibling", F.when(F.col("_p") == F.col("parent"), F.col("sibling"))).drop("_p"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    enter = named.select((2 * F.col("at")).alias("id"), F.coalesce(2 * F.col("child"), 2 * F.col("at") + 1).alias("next"), one.alias("n"), one.alias("deep"), one.alias("nodes"), "value")
    leave = named.select((2 * F.col("at") + 1).alias("id"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent_at") + 1).alias("next"), one.alias("n"), (-one).alias("deep"), none.alias("nodes"), (F.col("value") * 0).alias("value"))
    ranks = list_ranks(enter.union(leave), ["n", "deep", "nodes", "value"]).withColumn("at", F.expr("id div 2"))
    a = ranks.filter("id % 2 = 0").select("at", "last", F.col("n").alias("n1"), F.col("deep").alias("d1"), F.col("nodes").alias("c1"), F.col("value").alias("v1"))
    b = ranks.filter("id % 2 = 1").select("at", F.col("n").alias("n2"), F.col("nodes").alias("c2"), F.col("value").alias("v2"))
    both = round_of(named.select("at", "node", "parent").join(a, "at").join(b, "at"))
    trees = both.filter(F.col("parent").isNull()).select(F.expr("last"), F.col("node").alias("root"), F.col("n1").alias("length"))
    trees = running(trees, ["root"], F.col("length"), "upto").select("last", "root", "upto")
    out = both.join(trees, "last")
    return out.select("node", "parent", "root", (F.col("upto") - F.col("n1")).alias("enter"), (F.col("upto") - F.col("n2")).alias("leave"), (-F.col("d1")).alias("depth"), (F.col("c1") - F.col("c2")).alias("size"), (F.col("v1") - F.col("v2")).alias("total"))


def subtree_sums(parents: DataFrame, value: str) -> DataFrame:
    """(node, size, total): nodes and the sum of ``value`` in each node's subtree."""
    return tour(parents, value).select("node", "size", "total")


def range_extremes(places: DataFrame, asked: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds ``least`` and ``most`` of (low, high) over the places first … last of each row of ``asked``. ``places``: (place, low, high).

    Places are dealt into blocks of ``span``. Inside a block a range is a slice of its array; over whole blocks it is two
    overlapping runs of a power of two blocks, whose extremes are a table."""
    block = F.expr(f"place div {span}")
    blocks = round_of(places.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("held"), F.min("low").alias("low"), F.max("high").alias("high")))
    first, last = blocks.agg(F.min("block"), F.max("block")).first() or (None, None)
    first, longest = first or 0, (last or 0) - (first or 0)
    every = places.sparkSession.range(first, first + longest + 1).select(F.col("id").alias("block"))
    run = round_of(every.join(blocks, "block", "left").select(F.lit(0).alias("k"), "block", "low", "high"))
    runs, k = [run], 0
    while (2 << k) <= longest + 1:
        on = run.select((F.col("block") - (1 << k)).alias("block"), F.col("low").alias("_l"), F.col("high").alias("_h"))
        k += 1
        run = round_of(run.join(on, "block", "left").select(F.lit(k).alias("k"), "block", F.least("low", "_l").alias("low"), F.greatest("high", "_h").alias("high")))
        runs.append(run)
    table = reduce(DataFrame.union, runs)

    def inside(out: DataFrame, at: Column, name: str) -> DataFrame:
        b = blocks.select(F.col("block").alias("_b"), F.col("held").alias("_held"))
        got = F.filter("_held", lambda x: x["place"].between(F.col("first"), F.col("last")))
        out = out.withColumn("_at", at).join(b, F.col("_at") == F.col("_b"), "left")
        out = out.withColumn("_got", got)
        return out.withColumns({f"_{name}l": F.array_min(F.transform("_got", lambda x: x["low"])), f"_{name}h": F.array_max(F.transform("_got", lambda x: x["high"]))}).drop("_at", "_b", "_held", "_got")

    left, right = F.expr(f"first div {span}"), F.expr(f"last div {span}")
    out = inside(inside(asked, left, "x"), F.when(right > left, right), "y")
    wide = right - left - 1
    out = out.withColumn("_k", F.when(wide > 0, F.floor(F.log2(wide.cast("double"))).cast("int")))
    for name, begin in (("p", left + 1), ("q", right - F.expr("shiftleft(1L, _k)"))):
        t = table.select(F.col("k").alias("_tk"), F.col("block").alias("_tb"), F.col("low").alias(f"_{name}l"), F.col("high").alias(f"_{name}h"))
        out = out.withColumn("_from", begin).join(t, (F.col("_k") == F.col("_tk")) & (F.col("_from") == F.col("_tb")), "left").drop("_tk", "_tb", "_from")
    names = ("x", "y", "p", "q")
    return out.withColumns({"least": F.least(*(F.col(f"_{n}l") for n in names)), "most": F.greatest(*(F.col(f"_{n}h") for n in names))}).select(*asked.columns, "least", "most")


# ---- blocks, bridges and cut vertices


def blocks(edges: DataFrame) -> DataFrame:
    """(u, v, block): links of an undirected graph by biconnected component (Tarjan and Vishkin): two links are in one block if a
    cycle without repeated nodes holds both. A block is named by the smallest node that hangs on its links from above.

    A spanning forest is hung up and toured; over the links outside it a subtree reaches from ``least`` to ``most``, extremes of its
    range of the tour. A tree link, named by its lower node, goes with its parent's if its subtree reaches beyond the
    parent's, and with that of the other end of a link between two branches; blocks are the components of these pairs."""
    e = round_of(simple(edges).select("u", "v"))
    forest = round_of(bottleneck_forest(e.withColumn("w", F.lit(0))).select("u", "v"))
    t = round_of(tour(rooted(forest)).select("node", "parent", "enter", "leave"))
    end = lambda c: t.select(F.col("node").alias(c), F.col("enter").alias(f"{c}1"), F.col("leave").alias(f"{c}2"))
    other = round_of(e.join(forest, ["u", "v"], "left_anti").join(end("u"), "u").join(end("v"), "v"))
    reach = other.select(F.col("u").alias("node"), F.col("v1").alias("to")).union(other.select("v", "u1"))
    reach = reach.groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b"))
    places = t.join(reach, "node", "left").select(F.col("enter").alias("place"), F.least("enter", "a").alias("low"), F.greatest("enter", "b").alias("high"))
    low = range_extremes(places, t.filter(F.col("parent").isNotNull()).select("node", "parent", F.col("enter").alias("first"), F.col("leave").alias("last")))
    above = t.filter(F.col("parent").isNotNull()).select(F.col("node").alias("parent"), F.col("enter").alias("p1"), F.col("leave").alias("p2"))
    up = low.join(above, "parent").filter("least < p1 or most > p2").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    across = other.filter("u2 < v1 or v2 < u1").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    named = t.filter(F.col("parent").isNotNull()).select("node").join(connected_components(up.union(across)), "node", "left").select(F.col("node").alias("_n"), F.coalesce("component", "node").alias("block"))
    lower = e.join(end("u"), "u").join(end("v"), "v").select("u", "v", F.when(F.col("u1") < F.col("v1"), F.col("v")).otherwise(F.col("u")).alias("_n"))
    return lower.join(named, "_n").select("u", "v", "block")


def bridges(found: DataFrame) -> DataFrame:
    """(u, v): links whose loss parts their component: blocks of one link."""
    return found.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"), F.min("v").alias("v")).filter("n = 1").select("u", "v")


def cut_vertices(found: DataFrame) -> DataFrame:
    """(node, blocks): nodes whose loss parts their component: those in several blocks."""
    ends = found.select(F.col("u").alias("node"), "block").union(found.select("v", "block")).distinct()
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1")
