"""Graphs as edge tables: reachability, labels that spread, widest paths and max-plus levels.

Every loop is a fixpoint whose state is checkpointed each round and never collected; it ends when a round changes nothing, and
only then: values come from the input and move one way, so it does end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.components import connected_components
from tarnflow.operators.order import ranked
from tarnflow.operators.session import round_of


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def once(edges: DataFrame) -> DataFrame:
    """Each undirected link one time."""
    return edges.filter(F.col("src") < F.col("dst"))


def _between(nodes: DataFrame, edges: DataFrame, within: str | None = None) -> DataFrame:
    """The edges between two of the given nodes, with the value of ``within`` at either end (_a, _b)."""
    for end, name in (("src", "_a"), ("dst", "_b")):
        edges = edges.join(nodes.select(F.col("node_id").alias(end), *([F.col(within).alias(name)] if within else [])), end)
    return edges


def _bodies(nodes: DataFrame, edges: DataFrame, near: bool = False) -> DataFrame:
    """(node_id, body) of the given nodes, joined by edges between two of them."""
    cc = connected_components(edges, near=near).withColumnRenamed("node", "node_id")
    return nodes.select("node_id").join(cc, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("body"))


def bodies(nodes: DataFrame, edges: DataFrame, within: str | None = None) -> DataFrame:
    """(node_id, body): components of the given nodes, joined by edges inside one value of ``within``; a body is its lowest node."""
    e = _between(nodes, edges, within)
    return _bodies(nodes, e.filter(F.col("_a") == F.col("_b")) if within else e)


def numbered(labels: DataFrame, label: str, number: str = "number") -> DataFrame:
    """Labels numbered from 0 in ascending order; a row a label is ranked, not a row a node."""
    ranks = ranked(labels.select(label).distinct(), [label], number)
    return labels.join(ranks, label)


def connected_to(nodes: DataFrame, edges: DataFrame, seed: Column, within: str | None = None) -> DataFrame:
    """(node_id) of the nodes in a body that holds a seed."""
    b = bodies(nodes, edges, within)
    marked = nodes.filter(seed).select("node_id").join(b, "node_id").select("body").distinct()
    return b.join(marked, "body", "left_semi").select("node_id")


def bath_and_atmosphere(nodes: DataFrame, edges: DataFrame, suction: bool = False) -> DataFrame:
    """(node_id, bath, atmosphere) of exterior nodes of a raster (node_id, below, boundary): what is joined to the boundary below the
    surface, and above it, labelled in one pass; with suction the bath goes on through what is neither.

    A body is all bath, all atmosphere or neither, so suction goes from body to body: its links are those across the surface."""
    sided = nodes.select("node_id", F.col("below").cast("int").alias("side"), "boundary")
    e = round_of(_between(sided, edges, "side"))
    b = _bodies(sided, e.filter(F.col("_a") == F.col("_b")), near=True)
    b = round_of(b) if suction else b
    open_ = b.join(sided, "node_id").groupBy("body").agg(F.bool_or("boundary").alias("open"), F.first("side").alias("side"))
    named = open_.select("body", (F.col("open") & (F.col("side") == 1)).alias("bath"), (F.col("open") & (F.col("side") == 0)).alias("atmosphere"))
    if suction:
        named = round_of(named)
        across = e.filter(F.coalesce(F.col("_a") != F.col("_b"), F.lit(True))).select("src", "dst")  # a null side joins no body
        for end in ("src", "dst"):
            across = across.join(b.withColumnRenamed("node_id", "_n"), F.col(end) == F.col("_n")).withColumn(end, F.col("body")).drop("_n", "body")
        of = named.withColumnRenamed("body", "node_id")
        wet = connected_to(of.filter(~F.col("atmosphere")), across, F.col("bath")).select(F.col("node_id").alias("body"), F.lit(True).alias("_w"))
        named = named.join(wet, "body", "left").select("body", F.coalesce("_w", F.lit(False)).alias("bath"), "atmosphere")
    return b.join(named, "body").select("node_id", "bath", "atmosphere")


def hops_from(seeds: DataFrame, edges: DataFrame, most: int, label: str = "label") -> DataFrame:
    """(node_id, label, hops): each node within ``most`` steps takes the label of the nearest seed, the lowest on ties."""
    found = round_of(seeds.select("node_id", label, F.lit(0).alias("hops")))
    front = found
    for hop in range(1, most + 1):
        reached = front.join(edges, front["node_id"] == edges["src"]).groupBy(F.col("dst").alias("node_id")).agg(F.min(label).alias(label))
        front = round_of(reached.join(found.select("node_id"), "node_id", "left_anti").select("node_id", label, F.lit(hop).alias("hops")))
        if front.isEmpty():
            break
        found = round_of(found.union(front))
    return found


def widest_paths(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, width, hops): the widest bottleneck from any root over links (src, dst, width), both ways, and the fewest
    steps among the widest; roots are infinitely wide."""
    e = links.select("src", "dst", "width").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "width"))
    e = round_of(e.groupBy("src", "dst").agg(F.max("width").alias("width")))
    best = round_of(roots.select("node_id", F.lit(float("inf")).alias("width"), F.lit(0).alias("hops")))
    while True:
        step = best.withColumnRenamed("width", "w").join(e, best["node_id"] == e["src"]).select(F.col("dst").alias("node_id"), F.least("w", e["width"]).alias("width"), (F.col("hops") + 1).alias("hops"))
        better = round_of(best.union(step).groupBy("node_id").agg(F.min(F.struct((-F.col("width")).alias("n"), "hops")).alias("b")).select("node_id", (-F.col("b.n")).alias("width"), "b.hops"))
        changed = not better.exceptAll(best).isEmpty()
        best = better
        if not changed:
            break
    return best


def fed_levels(full: DataFrame, throats: DataFrame) -> DataFrame:
    """(lab, level): the highest level that feeds a full compartment through open throats and other full ones: a max-plus
    relaxation. ``throats``: a, b, level_a, level_b (null: nothing there), top; a feed counts only above the throat's top."""
    ways = throats.select(F.col("a").alias("at"), F.col("b").alias("by"), F.col("level_b").alias("level"), "top").union(throats.select(F.col("b"), F.col("a"), F.col("level_a"), "top"))
    ways = round_of(ways.join(full.select(F.col("lab").alias("at")), "at", "left_semi"))
    begun = ways.join(full.select(F.col("lab").alias("by")), "by", "left_anti").filter(F.col("level") > F.col("top"))
    best = round_of(begun.groupBy(F.col("at").alias("lab")).agg(F.max("level").alias("level"), F.lit(None).cast("double").alias("was")))
    while True:
        on = best.filter(F.col("was").isNull() | (F.col("level") > F.col("was")))  # a level that hasn't risen has fed what it can
        if on.isEmpty():
            return best.select("lab", "level")
        on = on.select(F.col("lab").alias("by"), F.col("level").alias("fed"))
        step = ways.join(on, "by").filter(F.col("fed") > F.col("top")).select(F.col("at").alias("lab"), F.col("fed").alias("level"), F.lit(None).cast("double").alias("was"))
        best = best.select("lab", "level", F.col("level").cast("double").alias("was")).union(step)
        best = round_of(best.groupBy("lab").agg(F.max("level").alias("level"), F.max("was").alias("was")))


def dilated(keys: DataFrame, axes: Sequence[str], dims: Sequence[int], radius: int) -> DataFrame:
    """All cells within a Chebyshev distance of the given ones, once each."""
    out = keys
    for axis, n in zip(axes, dims, strict=True):  # one axis after another: 3(2r+1) rows a cell instead of (2r+1)^3
        lo, hi = F.greatest(F.col(axis) - radius, F.lit(0)), F.least(F.col(axis) + radius, F.lit(n - 1))
        out = out.withColumn(axis, F.explode(F.sequence(lo, hi))).distinct()
    return out


def dag_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, level, arrived): the longest way to a node from one without an edge into it, in edges (src, dst), and how many edges
    came in; nodes on a cycle or behind one have no row.

    A node is ready when as many edges have arrived as lead to it. A round joins the edges that leave the nodes just made ready,
    each edge in one round only; what has arrived at the others waits as a sum a node, and no other row is touched."""
    e = edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    need = e.groupBy("dst").agg(F.count(F.lit(1)).alias("need"))
    e = round_of(e.join(need, "dst"))
    zero = F.lit(0).cast("long")
    front = round_of(nodes.select("node_id").distinct().join(need.select(F.col("dst").alias("node_id")), "node_id", "left_anti").select("node_id", zero.alias("level"), zero.alias("arrived")))
    done, waiting = [front], None
    while not front.isEmpty():
        came = e.join(front.select(F.col("node_id").alias("src"), "level"), "src").select("dst", "need", (F.col("level") + 1).alias("level"), F.lit(1).cast("long").alias("arrived"))
        came = came if waiting is None else came.union(waiting)
        now = round_of(came.groupBy("dst").agg(F.max("need").alias("need"), F.max("level").alias("level"), F.sum("arrived").alias("arrived")))
        waiting = now.filter("arrived < need").select("dst", "need", "level", "arrived")
        front = now.filter("arrived = need").select(F.col("dst").alias("node_id"), "level", "arrived")
        done.append(front)
    return reduce(DataFrame.union, done)
