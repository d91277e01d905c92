"""Trees over the graphs of the given tables: forests, merge trees, tours, blocks, merging, levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.operators import forest, graph, levels, merging, nearest
from tarnflow.plans.registry import query, r, table

_OFFERS = "(SELECT 2*l_partkey AS u, 2*l_suppkey + 1 AS v, min(l_extendedprice) AS w FROM lineitem GROUP BY ALL)"
_SALES = "(SELECT 2*o_custkey AS u, 2*l_suppkey + 1 AS v, min(l_extendedprice) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"


def _grown(edges: str, begun: str = "false") -> str:
    """Prim's algorithm: the lightest link out of the nodes that are done, one an iteration, as a table r (node, w, par, label, done)."""
    return f"""e AS MATERIALIZED (SELECT * FROM {edges}), both_ AS MATERIALIZED (SELECT u AS src, v AS dst, w FROM e UNION ALL SELECT v, u, w FROM e),
    r(node, w, par, label, done) USING KEY (node) AS (SELECT node, 'inf'::DOUBLE, -1::BIGINT, node, false FROM (SELECT DISTINCT src AS node FROM both_) UNION
    (WITH m AS (SELECT node, w, par, label FROM recurring.r WHERE NOT done ORDER BY NOT ({begun}), w, least(node, par), greatest(node, par), node LIMIT 1)
    SELECT node, w, par, label, true FROM m UNION ALL SELECT b.dst, b.w, m.node, m.label, false FROM m JOIN both_ b ON b.src = m.node JOIN recurring.r q ON q.node = b.dst
    WHERE NOT q.done AND NOT ({begun.replace('node', 'q.node')}) AND (b.w, least(b.src, b.dst), greatest(b.src, b.dst)) < (q.w, least(q.node, q.par), greatest(q.node, q.par))))"""


_PATHS = """t AS MATERIALIZED (SELECT node AS a, par AS b, w FROM r WHERE par >= 0 UNION ALL SELECT par, node, w FROM r WHERE par >= 0),
    p(x, y, came, top) AS (SELECT DISTINCT a, a, -1::BIGINT, '-inf'::DOUBLE FROM t UNION ALL SELECT p.x, t.b, p.y, greatest(p.top, t.w) FROM p JOIN t ON t.a = p.y AND t.b <> p.came)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers linked by line items, at the least price."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((2 * F.col("l_partkey")).alias("u"), (2 * F.col("l_suppkey") + 1).alias("v"), F.col("l_extendedprice").alias("w"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers linked by line items, at the least price."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select((2 * F.col("o_custkey")).alias("u"), (2 * F.col("l_suppkey") + 1).alias("v"), F.col("l_extendedprice").alias("w"))


@query(f"WITH RECURSIVE {_grown(_OFFERS)} SELECT least(node, par) AS u, greatest(node, par) AS v, w FROM r WHERE par >= 0")
def bottleneck_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of least prices between all parts and suppliers."""
    return forest.bottleneck_forest(offers(spark, sf_dir))


@query(f"WITH RECURSIVE {_grown(_OFFERS, '(node % 2 = 1)')} SELECT node, label FROM r")
def watershed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which supplier's basin each part falls in when all suppliers flood over the cheapest links first."""
    e = offers(spark, sf_dir)
    nodes = e.select(F.col("u").alias("node"), F.lit(None).cast("long").alias("marker")).union(e.select("v", "v")).distinct()
    return forest.watershed(nodes, e)


@query(f"WITH RECURSIVE {_grown(_SALES)}, {_PATHS} SELECT o_orderkey, coalesce(min(y), 2*any_value(o_custkey)) AS component FROM orders LEFT JOIN p ON x = 2*o_custkey AND (top <= o_totalprice / 250 OR x = y) GROUP BY 1")
def merge_tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order: the component of its customer over links of at most a 250th of its price, by its smallest node."""
    tree = forest.MergeTree(forest.merges(forest.bottleneck_forest(sales(spark, sf_dir))))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (2 * F.col("o_custkey")).alias("node"), (F.col("o_totalprice") / 250).alias("level"))
    return tree.component_at(asked, "node", "level").select("o_orderkey", "component")


@query(f"WITH RECURSIVE {_grown(_SALES)}, {_PATHS} SELECT a.o_orderkey, CASE WHEN a.o_custkey <> b.o_custkey THEN top END AS level FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 LEFT JOIN p ON x = 2*a.o_custkey AND y = 2*b.o_custkey")
def meeting_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order and the next one: the level at which their customers become one component."""
    tree = forest.MergeTree(forest.merges(forest.bottleneck_forest(sales(spark, sf_dir))))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (2 * F.col("o_custkey")).alias("a"))
    pairs = o.join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("a").alias("b")), "o_orderkey")
    return tree.joined_at(pairs, "a", "b").select("o_orderkey", "level")


@query(
    """WITH RECURSIVE n AS MATERIALIZED (SELECT l_partkey AS node, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY 1),
    p AS MATERIALIZED (SELECT a.l_partkey AS node, max(b.l_partkey) AS parent FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_partkey < a.l_partkey GROUP BY 1),
    up(node, at_) AS (SELECT node, node FROM n UNION ALL SELECT up.node, p.parent FROM up JOIN p ON p.node = up.at_)
    SELECT up.at_ AS node, count(*) AS size, sum(total)::BIGINT AS total FROM up JOIN n ON n.node = up.node GROUP BY 1"""
)
def subtree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts hang on the next smaller part of any of their orders; each part's subtree, with the quantity sold of it."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node"), F.col("l_quantity").cast("long").alias("n"))
    # The next smaller part of an order is the greatest of that order, the best over all orders the greatest of all.
    smaller = li.select("l_orderkey", F.col("node").alias("parent")).distinct()
    parents = li.select("l_orderkey", "node").distinct().join(smaller, "l_orderkey").filter("parent < node").groupBy("node").agg(F.max("parent").alias("parent"))
    parts = li.groupBy("node").agg(F.sum("n").alias("n")).join(parents, "node", "left")
    return forest.subtree_sums(parts, "n")


_REGULAR = "(SELECT 2*o_custkey AS u, 2*l_suppkey + 1 AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) >= 3)"


def regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers who have met in three line items or more."""
    return sales(spark, sf_dir).groupBy("u", "v").count().filter("count >= 3").select("u", "v")


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_REGULAR}), b AS MATERIALIZED (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e),
    c(node, comp) USING KEY (node) AS (SELECT DISTINCT a, a FROM b UNION (SELECT q.node, min(c.comp) FROM recurring.c AS q JOIN b ON b.b = q.node JOIN c ON c.node = b.a GROUP BY q.node HAVING min(c.comp) < any_value(q.comp))),
    d(node, depth) USING KEY (node) AS (SELECT DISTINCT comp, 0 FROM c UNION (SELECT DISTINCT b.b, d.depth + 1 FROM d JOIN b ON b.a = d.node WHERE b.b NOT IN (SELECT node FROM recurring.d))),
    t AS MATERIALIZED (SELECT x.node, min(b.b) AS parent FROM d x JOIN b ON b.a = x.node JOIN d y ON y.node = b.b AND y.depth = x.depth - 1 GROUP BY 1),
    up(node, at_) AS (SELECT node, node FROM t UNION ALL SELECT up.node, t.parent FROM up JOIN t ON t.node = up.at_ WHERE t.parent IN (SELECT node FROM t)),
    rest AS MATERIALIZED (SELECT e.u, e.v FROM e LEFT JOIN t s ON s.node = e.u AND s.parent = e.v LEFT JOIN t s2 ON s2.node = e.v AND s2.parent = e.u WHERE s.node IS NULL AND s2.node IS NULL),
    w AS (SELECT rest.u, rest.v, up.at_ FROM rest JOIN up ON up.node = rest.u UNION ALL SELECT rest.u, rest.v, up.at_ FROM rest JOIN up ON up.node = rest.v),
    covered AS (SELECT DISTINCT at_ FROM (SELECT u, v, at_ FROM w GROUP BY ALL HAVING count(*) = 1))
    SELECT least(node, parent) AS u, greatest(node, parent) AS v FROM t WHERE node NOT IN (SELECT at_ FROM covered)"""
)
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular links whose loss would part customers from suppliers."""
    return forest.bridges(forest.blocks(regular(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_REGULAR}), b AS MATERIALIZED (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e), n AS MATERIALIZED (SELECT a AS node, min(b) AS first FROM b GROUP BY 1 HAVING count(*) > 1),
    r(node, at_) AS (SELECT node, first FROM n UNION SELECT r.node, b.b FROM r JOIN b ON b.a = r.at_ WHERE b.b <> r.node)
    SELECT DISTINCT n.node FROM n JOIN b ON b.a = n.node ANTI JOIN r ON r.node = n.node AND r.at_ = b.b"""
)
def cut_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers whose loss would part others that regular links join."""
    return forest.cut_vertices(forest.blocks(regular(spark, sf_dir))).select("node")


_TRADE = "(SELECT 2*c_nationkey::BIGINT AS a, 2*l_suppkey + 1 AS b, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM {_TRADE}), n AS MATERIALIZED (SELECT label, max(w) AS peak, count(*)::DOUBLE AS size FROM (SELECT a AS label, w FROM p UNION ALL SELECT b, w FROM p) GROUP BY 1),
    m(step, label, into_, peak, size) AS (SELECT 0, label, label, peak, size FROM n UNION ALL
    (WITH g AS (SELECT least(x.into_, y.into_) AS a, greatest(x.into_, y.into_) AS b, min(row(-p.w, p.a, p.b)) AS way, least(any_value(x.peak), any_value(y.peak)) AS low, greatest(any_value(x.peak), any_value(y.peak)) AS top, least(any_value(x.size), any_value(y.size)) < 8 AS small, any_value(x.size) + any_value(y.size) AS whole
     FROM p JOIN m x ON x.label = p.a JOIN m y ON y.label = p.b WHERE x.into_ <> y.into_ GROUP BY 1, 2),
     best AS (SELECT * FROM g WHERE -way[1] >= 0.93*low OR small ORDER BY NOT small, way[1]/low, way[2], way[3] LIMIT 1)
     SELECT m.step + 1, m.label, CASE WHEN m.into_ = best.b THEN best.a ELSE m.into_ END, CASE WHEN m.into_ IN (best.a, best.b) THEN best.top ELSE m.peak END, CASE WHEN m.into_ IN (best.a, best.b) THEN best.whole ELSE m.size END FROM m, best))
    SELECT label, into_ AS "into" FROM m WHERE step = (SELECT max(step) FROM m)"""
)
def merged_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and suppliers merged over their trade, the most open first: a pair joins if its trade is 93 % of the
    weaker one's best, or if a side trades with less than eight others."""
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = li.groupBy((2 * F.col("c_nationkey").cast("long")).alias("a"), (2 * F.col("l_suppkey") + 1).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("opening"))
    ends = pairs.select(F.col("a").alias("label"), "opening").union(pairs.select("b", "opening"))
    regions = ends.groupBy("label").agg(F.max("opening").alias("peak"), F.count(F.lit(1)).cast("double").alias("size"))
    return merging.merged(regions, pairs, beta=0.93, r_free=float("inf"), least=8)


@query(
    """WITH RECURSIVE o AS MATERIALIZED (SELECT o_orderkey AS node, lead(o_orderkey) OVER w AS a, lead(o_orderkey, 3) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    e AS MATERIALIZED (SELECT node AS src, a AS dst FROM o WHERE a IS NOT NULL UNION ALL SELECT node, b FROM o WHERE b IS NOT NULL),
    r(node, level) AS (SELECT node, 0 FROM o WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node)
    SELECT r.node AS node_id, max(level)::BIGINT AS level, any_value(coalesce(n, 0)) AS arrived FROM r LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) d ON d.dst = r.node GROUP BY 1"""
)
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the longest way over a customer's later orders (the next one and the third after it)."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey", 1).over(w).alias("a"), F.lead("o_orderkey", 3).over(w).alias("b"))
    o = o.select("src", F.explode(F.array("a", "b")).alias("dst"))
    return graph.dag_levels(o, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id")))


def _half(keys: str, where: str) -> str:
    return f"(SELECT '{where}' AS grouped, {keys} AS key, min(v) AS level, any_value(total)::BIGINT AS weight FROM (SELECT *, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY {keys} ORDER BY l_extendedprice) AS upto, sum(l_quantity) OVER (PARTITION BY {keys}) AS total FROM lineitem) WHERE upto >= 0.4 * total GROUP BY ALL)"


@query(f"SELECT * FROM {_half('l_linestatus', 'status')} UNION ALL SELECT grouped, key::VARCHAR, level, weight FROM {_half('l_suppkey', 'supplier')} UNION ALL SELECT grouped, key::VARCHAR, level, weight FROM {_half('l_orderkey', 'order')}")
def weighted_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price up to which four tenths of the quantity go, by status (two groups), by supplier and by order."""
    li, w = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    out = [levels.weighted_levels(li, [k], "l_extendedprice", w, 0.4).select(F.lit(n).alias("grouped"), F.col(k).cast("string").alias("key"), "level", "weight") for n, k in (("status", "l_linestatus"), ("supplier", "l_suppkey"), ("order", "l_orderkey"))]
    return reduce(DataFrame.union, out)


_RING = "(SELECT user_id, user_id % 7 + (1 + event_id % 3 / 20.0)*cos(radians(event_id*37 % 360)) AS x, user_id % 5 + (1 + event_id % 3 / 20.0)*sin(radians(event_id*37 % 360)) AS y FROM events)"


@query(
    f"""WITH m AS (SELECT user_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, x*x + y*y) AS xz, covar_pop(y, x*x + y*y) AS yz FROM {_RING} GROUP BY 1),
    c AS (SELECT *, CASE WHEN xx*yy - xy*xy > 1e-12*(xx + yy)^2 THEN (xz*yy - yz*xy)/(2*(xx*yy - xy*xy)) END AS cx, CASE WHEN xx*yy - xy*xy > 1e-12*(xx + yy)^2 THEN (yz*xx - xz*xy)/(2*(xx*yy - xy*xy)) END AS cy FROM m)
    SELECT user_id, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(xx + yy + (mx - cx)^2 + (my - cy)^2), 6) AS radius FROM c"""
)
def fitted_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circle through each user's events, placed round the user by their numbers."""
    e, u = F.col("event_id"), F.col("user_id")
    angle, out = F.radians((e * 37 % 360).cast("double")), 1 + e % 3 / 20.0
    points = table(spark, sf_dir, "events").select("user_id", (u % 7 + out * F.cos(angle)).alias("x"), (u % 5 + out * F.sin(angle)).alias("y"))
    return levels.fitted_circles(points, ["user_id"], "x", "y").select("user_id", "n", *(r(F.col(c)).alias(c) for c in ("cx", "cy", "radius")))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS other, round(list_distance(a.e, b.e), 9) AS d FROM v a JOIN v b ON b.label % 5 = 0 WHERE a.label % 5 <> 0)
    SELECT vec_id, (min(row(d, other)))[2] AS other, round(min(d), 6) AS distance FROM d GROUP BY 1"""
)
def nearest_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector the nearest one that carries a label of every fifth, over all components and at any distance."""
    v = table(spark, sf_dir, "embeddings")
    out = nearest.nearest(v.filter("label % 5 <> 0"), "vec_id", v.filter("label % 5 = 0"), "vec_id", "embedding")
    return out.select("vec_id", "other", r(F.col("distance")).alias("distance"))
