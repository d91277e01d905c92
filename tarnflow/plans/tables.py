"""Graph, key, spatial and pool operators on the driver's tables and on scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.operators import bodies, graph, keys, near
from tarnflow.operators.components import connected_components
from tarnflow.operators.order import running
from tarnflow.plans.registry import micros, query, r, table
from tarnflow.sources import scenes
from tarnflow.sources.scenes import Raster

MAZE = Raster((1 << 40, 12, 6), 1.0, (0.0, 0.0, 0.0))
_MAZE = "(SELECT o_orderkey AS node_id, o_orderkey // 72 AS i, (o_orderkey // 6) % 12 AS j, o_orderkey % 6 AS k FROM orders WHERE o_custkey % 100 >= 45)"
_MAZE_LINKS = f"(SELECT a.node_id AS src, b.node_id AS dst FROM {_MAZE} a JOIN (VALUES (-72), (-6), (-1), (1), (6), (72)) s(s) ON true JOIN {_MAZE} b ON b.node_id = a.node_id + s.s WHERE abs(a.i-b.i) + abs(a.j-b.j) + abs(a.k-b.k) = 1)"


def maze(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a raster of 12 by 6 cells and as long as there are orders, closed where the customer's number says so; its open cells and their links."""
    n = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").select(n.alias("node_id"), F.floor(n / 72).alias("i"), (F.floor(n / 6) % 12).cast("int").alias("j"), (n % 6).cast("int").alias("k"), (F.col("o_custkey") % 100 < 45).alias("solid"))
    cells = cells.withColumn("boundary", F.col("j").isin(0, 11) | F.col("k").isin(0, 5))
    return cells.filter("not solid"), scenes.face_links(MAZE, cells)


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED (SELECT * FROM {_MAZE_LINKS}), r(node_id, body) USING KEY (node_id) AS (SELECT node_id, node_id FROM {_MAZE} UNION
    (SELECT n.node_id, min(r.body) FROM recurring.r AS n JOIN l e ON e.dst = n.node_id JOIN r ON r.node_id = e.src GROUP BY n.node_id HAVING min(r.body) < any_value(n.body)))
    SELECT node_id, body, dense_rank() OVER (ORDER BY body) - 1 AS number FROM r"""
)
def raster_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the open cells of a maze, named by their lowest node and numbered in that order."""
    cells, links = maze(spark, sf_dir)
    return graph.numbered(graph.bodies(cells, links), "body").select("node_id", "body", F.col("number").cast("long").alias("number"))


@query(
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, k < 3 AS below, j IN (0, 11) OR k IN (0, 5) AS boundary FROM {_MAZE}),
    e AS MATERIALIZED (SELECT src, dst FROM {_MAZE_LINKS} l JOIN n a ON a.node_id = l.src JOIN n b ON b.node_id = l.dst WHERE a.below = b.below),
    r(node_id) AS (SELECT node_id FROM n WHERE boundary UNION SELECT e.dst FROM r JOIN e ON e.src = r.node_id)
    SELECT node_id, below AND node_id IN (SELECT node_id FROM r) AS bath, NOT below AND node_id IN (SELECT node_id FROM r) AS atmosphere FROM n"""
)
def bath_atmosphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, links = maze(spark, sf_dir)
    return graph.bath_and_atmosphere(cells.withColumn("below", F.col("k") < 3), graph.once(links))


@query(
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, k < 3 AS below, j IN (0, 11) OR k IN (0, 5) AS boundary FROM {_MAZE}),
    l AS MATERIALIZED (SELECT * FROM {_MAZE_LINKS}), e AS MATERIALIZED (SELECT src, dst FROM l JOIN n a ON a.node_id = l.src JOIN n b ON b.node_id = l.dst WHERE a.below = b.below),
    r(node_id) AS (SELECT node_id FROM n WHERE boundary UNION SELECT e.dst FROM r JOIN e ON e.src = r.node_id),
    air AS (SELECT n.node_id FROM n JOIN r USING (node_id) WHERE NOT below), wet(node_id) AS (SELECT node_id FROM n JOIN r USING (node_id) WHERE below
    UNION SELECT l.dst FROM wet JOIN l ON l.src = wet.node_id WHERE l.dst NOT IN (SELECT node_id FROM air)) SELECT node_id FROM wet"""
)
def connected_suction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bath with suction: what is joined to it without passing the atmosphere."""
    cells, links = maze(spark, sf_dir)
    return graph.bath_and_atmosphere(cells.withColumn("below", F.col("k") < 3), graph.once(links), suction=True).filter("bath").select("node_id")


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED (SELECT * FROM {_MAZE_LINKS}), r(node_id, hops) AS (SELECT node_id, 0 FROM {_MAZE} WHERE node_id % 97 = 0 UNION SELECT l.dst, hops + 1 FROM r JOIN l ON l.src = r.node_id WHERE hops < 5),
    d AS (SELECT node_id, min(hops) AS hops FROM r GROUP BY 1), s(node_id, label, hops) AS (SELECT node_id, node_id, 0 FROM {_MAZE} WHERE node_id % 97 = 0 UNION SELECT l.dst, s.label, s.hops + 1 FROM s JOIN l ON l.src = s.node_id JOIN d ON d.node_id = l.dst AND d.hops = s.hops + 1)
    SELECT node_id, min(label) AS label, min(hops)::INT AS hops FROM s GROUP BY 1"""
)
def bfs_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, links = maze(spark, sf_dir)
    return graph.hops_from(cells.filter("node_id % 97 = 0").withColumn("label", F.col("node_id")), links, 5)


_LIKE = "((l_partkey*51 + l_quantity::BIGINT)*100 + round(l_discount*100)::BIGINT)"


@query(
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT DISTINCT 2*l_orderkey AS node, 2*{_LIKE} + 1 AS other FROM lineitem), l AS MATERIALIZED (SELECT node AS src, other AS dst FROM n UNION SELECT other, node FROM n),
    r(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM l UNION (SELECT q.node, min(r.component) FROM recurring.r AS q JOIN l ON l.dst = q.node JOIN r ON r.node = l.src GROUP BY q.node HAVING min(r.component) < any_value(q.component)))
    SELECT node, component FROM r"""
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders that share a line item of the same part, quantity and discount."""
    like = (F.col("l_partkey") * 51 + F.col("l_quantity").cast("long")) * 100 + F.round(F.col("l_discount") * 100).cast("long")
    return connected_components(table(spark, sf_dir, "lineitem").select((2 * F.col("l_orderkey")).alias("src"), (2 * like + 1).alias("dst")))


_TRADE = """(SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*)::DOUBLE AS width FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
 JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE c.c_nationkey <> s.s_nationkey GROUP BY 1, 2)"""


@query(
    f"""WITH RECURSIVE t AS (SELECT src, dst, max(width) AS width FROM (SELECT src, dst, width FROM {_TRADE} UNION ALL SELECT dst, src, width FROM {_TRADE}) GROUP BY 1, 2),
    w(node, width, n) AS (SELECT n_nationkey::BIGINT, CASE WHEN n_nationkey = 0 THEN 'inf'::DOUBLE ELSE 0 END, 0 FROM nation UNION ALL
    SELECT w.node, greatest(w.width, (SELECT coalesce(max(least(x.width, t.width)), 0) FROM w x JOIN t ON t.src = x.node AND t.dst = w.node)), w.n + 1 FROM w WHERE w.n < 26)
    SELECT node::INT AS node_id, max(width) AS width FROM w GROUP BY 1 HAVING max(width) > 0"""
)
def widest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest bottleneck of trade between nation 0 and every other."""
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    links = li.filter("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("width"))
    return graph.widest_paths(links, t("nation").filter("n_nationkey = 0").select(F.col("n_nationkey").alias("node_id"))).select("node_id", "width")


_CHAIN = "(SELECT o_orderkey AS a, o_orderkey + 1 AS b, CASE WHEN o_orderkey % 7 = 0 THEN 5.0 END AS level_a, CASE WHEN o_orderkey % 7 = 6 THEN 2.0 + (o_custkey % 40)/10.0 END AS level_b, (o_custkey % 5)/2.0 AS top FROM orders)"


@query(
    f"""WITH RECURSIVE w AS MATERIALIZED (SELECT a AS at_, b AS by_, level_b AS level, top FROM {_CHAIN} UNION ALL SELECT b, a, level_a, top FROM {_CHAIN}), f AS MATERIALIZED (SELECT * FROM w WHERE at_ % 7 <> 0),
    r(lab, level) AS (SELECT at_, level FROM f WHERE by_ % 7 = 0 AND level > top UNION SELECT f.at_, r.level FROM r JOIN f ON f.by_ = r.lab WHERE r.level > f.top AND f.by_ % 7 <> 0)
    SELECT lab, max(level) AS level FROM r GROUP BY 1"""
)
def max_plus_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeding levels through chains of orders as full compartments; every seventh isn't full, and a customer's number is an opening's top."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    throats = table(spark, sf_dir, "orders").select(k.alias("a"), (k + 1).alias("b"), F.when(k % 7 == 0, 5.0).alias("level_a"), F.when(k % 7 == 6, 2.0 + (c % 40) / 10.0).alias("level_b"), ((c % 5) / 2.0).alias("top"))
    full = throats.select(F.col("a").alias("lab")).union(throats.select("b")).distinct().filter("lab % 7 <> 0")
    return graph.fed_levels(full, throats)


# ---- keys


@query("WITH c AS (SELECT DISTINCT o_orderkey % 96 AS i, o_custkey % 80 AS j, (o_orderkey // 7) % 64 AS k FROM orders), o AS (SELECT range - 2 AS d FROM range(5)) SELECT DISTINCT (((i+a.d)*80 + (j+b.d))*64 + (k+c2.d))::BIGINT AS key FROM c, o a, o b, o c2 WHERE i+a.d BETWEEN 0 AND 95 AND j+b.d BETWEEN 0 AND 79 AND k+c2.d BETWEEN 0 AND 63")
def region_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = [(F.col("o_orderkey") % 96), (F.col("o_custkey") % 80), (F.floor(F.col("o_orderkey") / 7) % 64)]
    return keys.grown(table(spark, sf_dir, "orders").select(G.flat_key(index, (96, 80, 64)).alias("key")).distinct(), (96, 80, 64), 2)


@query("SELECT DISTINCT (((o_orderkey % 64 // 2) * 16 + (o_custkey % 32 // 2)) * 8 + (o_orderkey // 3) % 16 // 2)::BIGINT AS key FROM orders")
def parents_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = [F.col("o_orderkey") % 64, F.col("o_custkey") % 32, F.floor(F.col("o_orderkey") / 3) % 16]
    return keys.parents(table(spark, sf_dir, "orders").select(G.flat_key(index, (64, 32, 16)).alias("key")), (64, 32, 16))


@query("SELECT DISTINCT (((i*2 + o // 4)*60 + (j*2 + (o // 2) % 2))*50 + k*2 + o % 2)::BIGINT AS key FROM (SELECT p_partkey % 40 AS i, p_size % 30 AS j, (p_partkey // 8) % 25 AS k FROM part), (SELECT range AS o FROM range(8))")
def children_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = [F.col("p_partkey") % 40, F.col("p_size") % 30, F.floor(F.col("p_partkey") / 8) % 25]
    return keys.children(table(spark, sf_dir, "part").select(G.flat_key(index, (40, 30, 25)).alias("key")), (80, 60, 50))


@query("SELECT o_orderkey, o_custkey IN (SELECT s_suppkey * 3 FROM supplier) AS found, (SELECT count(*) FROM supplier WHERE s_suppkey * 3 < o_custkey) AS position FROM orders")
def sorted_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of keys in a sorted set and how many of the set are smaller: a running count over both, one shuffle a block of keys."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("key")).distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    # Positions: counts a block of keys, added up over the few blocks, and ranks inside a block.
    block = F.floor(F.col("key") / 4096)
    sizes = s.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    blocks = o.select(block.alias("block")).union(s.select(block.alias("block"))).distinct().join(sizes, "block", "left")
    starts = blocks.withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    line = o.select("key", "o_orderkey", F.lit(0).alias("is_set")).unionByName(s.select("key", F.lit(1).alias("is_set")), allowMissingColumns=True).withColumn("block", block)
    w = W.partitionBy("block").orderBy("key").rangeBetween(W.unboundedPreceding, -1)
    line = line.withColumn("inside", F.coalesce(F.sum("is_set").over(w), F.lit(0))).withColumn("found", F.max("is_set").over(W.partitionBy("block", "key")) == 1)
    return line.filter("is_set = 0").join(starts, "block").select("o_orderkey", "found", (F.col("before") + F.col("inside")).alias("position"))


_OCT = """long AS (SELECT ((max(s_suppkey) // 2) // 4 + 1) * 4 AS n FROM supplier), c AS (SELECT range AS key, range // 256 AS i, (range // 16) % 16 AS j, range % 16 AS k FROM range((SELECT n * 256 FROM long))),
 closed AS (SELECT DISTINCT s_suppkey // 2 AS i, s_nationkey % 16 AS j, s_suppkey * 5 % 16 AS k FROM supplier), o AS (SELECT a.range - 1 AS a, b.range - 1 AS b, d.range - 1 AS d FROM range(3) a, range(3) b, range(3) d),
 r0 AS (SELECT DISTINCT i+a AS i, j+b AS j, k+d AS k FROM closed, o, long WHERE i+a BETWEEN 0 AND n-1 AND j+b BETWEEN 0 AND 15 AND k+d BETWEEN 0 AND 15), r1 AS (SELECT DISTINCT i//2 AS i, j//2 AS j, k//2 AS k FROM r0),
 g1 AS (SELECT DISTINCT i+a AS i, j+b AS j, k+d AS k FROM r1, o, long WHERE i+a BETWEEN 0 AND n//2-1 AND j+b BETWEEN 0 AND 7 AND k+d BETWEEN 0 AND 7), r2 AS (SELECT DISTINCT i//2 AS i, j//2 AS j, k//2 AS k FROM g1),
 c1 AS (SELECT range // 64 AS i, (range // 8) % 8 AS j, range % 8 AS k FROM range((SELECT n * 32 FROM long))), c2 AS (SELECT range // 16 AS i, (range // 4) % 4 AS j, range % 4 AS k FROM range((SELECT n * 4 FROM long))),
 leaves AS (SELECT 2 AS level, i, j, k FROM c2 ANTI JOIN r2 USING (i, j, k) UNION ALL SELECT 1, c1.i, c1.j, c1.k FROM c1 JOIN r2 ON r2.i = c1.i//2 AND r2.j = c1.j//2 AND r2.k = c1.k//2 ANTI JOIN r1 ON r1.i = c1.i AND r1.j = c1.j AND r1.k = c1.k
 UNION ALL SELECT 0, c.i, c.j, c.k FROM c JOIN r1 ON r1.i = c.i//2 AND r1.j = c.j//2 AND r1.k = c.k//2 ANTI JOIN closed d ON d.i = c.i AND d.j = c.j AND d.k = c.k)"""


def octree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """Leaves of an octree of two levels round the suppliers' cells, and its dimensions: as long as there are suppliers."""
    n = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    dims = ((s.agg(F.max(n)).first()[0] or 0) // 2 // 4 * 4 + 4, 16, 16)
    closed = s.select(G.flat_key([F.floor(n / 2), F.col("s_nationkey") % 16, n * 5 % 16], dims).alias("key")).distinct()
    return keys.graded(closed, dims, 2), dims


@query(f"WITH {_OCT} SELECT level::INT AS level, ((i * (16 >> level) + j) * (16 >> level) + k)::BIGINT AS key FROM leaves")
def octree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a graded octree round closed cells."""
    return octree(spark, sf_dir)[0]


@query(f"WITH {_OCT}, n AS (SELECT level, count(*) AS leaves FROM leaves GROUP BY 1) SELECT level::INT AS level, leaves, coalesce(sum(leaves) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"first\" FROM n")
def octree_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.offsets(octree(spark, sf_dir)[0], 2)


@query(
    f"""WITH {_OCT}, b AS (SELECT *, i << level AS x0, j << level AS y0, k << level AS z0, 1 << level AS s, ((i * (16 >> level) + j) * (16 >> level) + k)::BIGINT AS key FROM leaves),
    t AS (SELECT a.level, a.key, b.level AS other_level, b.key AS other_key FROM b a JOIN b ON (a.level < b.level OR a.level = b.level AND a.key < b.key)
    AND ((a.x0 + a.s = b.x0 OR b.x0 + b.s = a.x0) AND a.y0 < b.y0 + b.s AND b.y0 < a.y0 + a.s AND a.z0 < b.z0 + b.s AND b.z0 < a.z0 + a.s
    OR (a.y0 + a.s = b.y0 OR b.y0 + b.s = a.y0) AND a.x0 < b.x0 + b.s AND b.x0 < a.x0 + a.s AND a.z0 < b.z0 + b.s AND b.z0 < a.z0 + a.s
    OR (a.z0 + a.s = b.z0 OR b.z0 + b.s = a.z0) AND a.x0 < b.x0 + b.s AND b.x0 < a.x0 + a.s AND a.y0 < b.y0 + b.s AND b.y0 < a.y0 + a.s))
    SELECT level::INT AS level, key, other_level::INT AS other_level, other_key FROM t"""
)
def octree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face links of the leaves; the SQL compares the cubes themselves, so it also shows that levels differ by one at most."""
    leaves, dims = octree(spark, sf_dir)
    return keys.leaf_links(leaves, dims, 2)


_POINTS = "(SELECT p_partkey, (p_partkey * 37 % 181)/10.0 - 1 AS x, (p_partkey * 53 % 173)/10.0 - 0.5 AS y, (p_size * 29 % 167)/10.0 AS z FROM part)"


@query(
    f"""WITH {_OCT} SELECT p_partkey, level::INT AS level, ((i * (16 >> level) + j) * (16 >> level) + k)::BIGINT AS key FROM {_POINTS} LEFT JOIN (SELECT leaves.*, n FROM leaves, long)
    ON floor(x)::INT >> level = i AND floor(y)::INT >> level = j AND floor(z)::INT >> level = k AND x >= 0 AND y >= 0 AND z >= 0 AND x < n AND y < 16 AND z < 16"""
)
def octree_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf that holds each of the parts, placed in the box by a formula."""
    k, s = F.col("p_partkey"), F.col("p_size")
    points = table(spark, sf_dir, "part").select("p_partkey", ((k * 37 % 181) / 10.0 - 1).alias("x"), ((k * 53 % 173) / 10.0 - 0.5).alias("y"), ((s * 29 % 167) / 10.0).alias("z"))
    leaves, dims = octree(spark, sf_dir)
    return keys.located(points, leaves, dims, 2, 1.0, (0, 0, 0)).select("p_partkey", "level", "key")


# ---- spatial joins


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *(e[i].cast("double").alias(c) for i, c in enumerate("xyz")), "label")


_V = "(SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"
_DIST = "sqrt((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2)"


@query(f"SELECT a.vec_id, round(coalesce(min({_DIST}) FILTER ({_DIST} <= 0.2), 0.2), 6) AS distance FROM {_V} a LEFT JOIN {_V} b ON b.label % 5 = 0 WHERE a.label % 5 <> 0 GROUP BY 1")
def capped_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return near.capped_nearest(v.filter("label % 5 <> 0"), "vec_id", v.filter("label % 5 = 0"), "xyz", 0.2).select("vec_id", r(F.col("distance")).alias("distance"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DIST}, 6) AS distance FROM {_V} a JOIN {_V} b ON a.vec_id < b.vec_id WHERE {_DIST} <= 0.06")
def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return near.radius_join(v, v, "xyz", 0.06).filter("vec_id < r_vec_id").select(F.col("vec_id").alias("a"), F.col("r_vec_id").alias("b"), r(F.col("distance")).alias("distance"))


@query(f"SELECT a.vec_id, bool_or(coalesce({_DIST} <= (b.vec_id % 4 + 1)*0.04, false)) AS sealed FROM {_V} a LEFT JOIN {_V} b ON b.label = 3 GROUP BY 1")
def seal_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples inside any of the seals, spheres of four sizes."""
    v = vectors(spark, sf_dir)
    seals = v.filter("label = 3").withColumn("radius", (F.col("vec_id") % 4 + 1) * 0.04)
    hit = near.inside_any(v, "vec_id", seals, "xyz", 0.16).withColumn("sealed", F.lit(True))
    return v.select("vec_id").join(hit, "vec_id", "left").select("vec_id", F.coalesce("sealed", F.lit(False)).alias("sealed"))


@query(f"SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY floor(x/0.1), floor(y/0.1), floor(z/0.1) ORDER BY vec_id) AS n FROM {_V}) WHERE n = 1")
def thin_one_per_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.thinned(vectors(spark, sf_dir), ["vec_id"], "xyz", 0.1).select("vec_id")


@query("SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS a, greatest(a.l_suppkey, b.l_suppkey) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_suppkey <> b.l_suppkey")
def facing_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of labels that face each other: a sample's partner is the next line of its order."""
    return bodies.facing(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_suppkey")


# ---- pools, ranks and reports


_CELL = "(SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS body, l_quantity/50.0 AS liquid, l_extendedprice/1e4 AS v, (l_partkey % 100)/10.0 AS h, 0.5 AS e, l_suppkey % 20 = 7 AS bath, l_tax > 0.04 AS air FROM lineitem)"


def pool_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells of bodies."""
    s = F.col("l_suppkey") % 20
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("body"), (F.col("l_quantity") / 50.0).alias("liquid"), (F.col("l_extendedprice") / 1e4).alias("v"), ((F.col("l_partkey") % 100) / 10.0).alias("h"), F.lit(0.5).alias("e"), (s == 7).alias("bath"), (F.col("l_tax") > 0.04).alias("air"))


@query(
    f"""WITH l AS (SELECT *, max(h - e + 2*e*liquid) OVER (PARTITION BY body) AS level FROM {_CELL})
    SELECT body, bool_or(bath) AS bath, round(sum(liquid*v) FILTER (NOT bath), 4) AS volume, round(max(level), 6) AS level, round(CASE WHEN bool_or(bath) THEN NULL ELSE coalesce(sum(v/(2*e)) FILTER (h - e < level AND level <= h + e), 0) END, 4) AS area FROM l GROUP BY 1"""
)
def body_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bodies.body_stats(pool_cells(spark, sf_dir))
    return out.select("body", "bath", r(F.col("volume"), 4).alias("volume"), r(F.col("level")).alias("level"), r(F.col("area"), 4).alias("area"))


@query(
    f"""SELECT body, round(sum(liquid*v), 3) AS liquid, round(coalesce(sum(liquid*v) FILTER (NOT bath), 0), 3) AS retained, round(coalesce(sum(liquid*v) FILTER (h >= 5), 0), 3) AS above_bath,
    round(coalesce(sum((1-liquid)*v) FILTER (h < 5), 0), 3) AS air_below, round(coalesce(sum((1-liquid)*v) FILTER (NOT air), 0), 3) AS air_trapped, grouping(body) AS whole FROM {_CELL} GROUP BY GROUPING SETS ((body), ())"""
)
def record_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bodies.record_sums(pool_cells(spark, sf_dir).withColumn("zb", F.lit(5.0)), "body")
    return out.select("body", *(r(F.col(c), 3).alias(c) for c in ("liquid", "retained", "above_bath", "air_below", "air_trapped")), "whole")


@query("SELECT c_nationkey AS region, count(*) AS n, round(max(c_acctbal), 6) AS volume, row_number() OVER (ORDER BY sum(c_acctbal) DESC, c_nationkey) AS rank FROM customer GROUP BY 1 HAVING sum(c_acctbal) > 0 ORDER BY rank LIMIT 10")
def pockets_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest bodies by volume."""
    top = bodies.largest(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "region"), "region", F.col("c_acctbal"), 10)
    return top.select("region", "n", r(F.col("volume")).alias("volume"), "rank")


@query(
    """WITH t AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey) * 0.4 AS dv, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(greatest(0, least(l_quantity, dv - before)), 6) AS taken FROM t"""
)
def take_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty per cent of each order removed from its latest lines first."""
    li = table(spark, sf_dir, "lineitem").withColumn("dv", 0.4 * F.sum("l_quantity").over(W.partitionBy("l_orderkey")))
    out = bodies.take_top(li, ["l_orderkey"], [F.col("l_shipdate").desc(), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))], F.col("l_quantity"), F.col("dv"))
    return out.select("l_orderkey", "l_linenumber", r(F.col("taken")).alias("taken"))


@query(
    """WITH t AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey) * 0.3 AS amount, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_partkey % 10) AS upto, sum(l_quantity) OVER (PARTITION BY l_suppkey, l_partkey % 10) AS layer FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(l_quantity * greatest(0, least(1, (amount - (upto - layer))/layer)), 5) AS filled FROM t"""
)
def partial_layer_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty per cent of a supplier's volume filled in layers; the partial layer is shared by room."""
    li = table(spark, sf_dir, "lineitem").withColumn("layer", F.col("l_partkey") % 10).withColumn("amount", 0.3 * F.sum("l_quantity").over(W.partitionBy("l_suppkey")))
    out = bodies.layer_fill(li, ["l_suppkey"], "layer", F.col("l_quantity"), F.col("amount"))
    return out.select("l_orderkey", "l_linenumber", r(F.col("filled"), 5).alias("filled"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority <> '1-URGENT', o_orderdate, o_orderkey) AS rank FROM orders")
def height_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks first, then by height, then by node, in each region."""
    o = table(spark, sf_dir, "orders")
    out = running(o.withColumn("dry", F.col("o_orderpriority") != "1-URGENT"), ["dry", "o_orderdate", "o_orderkey"], F.lit(1), "rank", ["o_orderstatus"])
    return out.select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH c AS (SELECT user_id, epoch_us(ts) AS t, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events), e AS (SELECT *, first_value(v) OVER w AS a, last_value(v) OVER w AS b FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT user_id, share, min(t) AS t FROM e, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) s(share) WHERE a <> b AND abs(v - a) >= share*abs(b - a) - 1e-12 GROUP BY 1, 2"""
)
def threshold_crossings_50_90_99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When 50, 90 and 99 % of each user's total has come."""
    e = table(spark, sf_dir, "events").withColumn("t", micros(F.col("ts")))
    e = e.withColumn("v", F.sum("value").over(W.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, 0))).withColumn("o", F.struct("t", "event_id"))
    out = bodies.crossing_times(e.select("user_id", "o", "v"), ["user_id"], "o", "v", [0.5, 0.9, 0.99])
    return out.select("user_id", "share", F.col("o.t").alias("t"))


@query("WITH s AS (SELECT *, epoch_us(ts)/1e6 AS t, lag(epoch_us(ts)/1e6) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t0 FROM events) SELECT event_id, round(sum(abs(value) * coalesce(t - t0, 0)) OVER (PARTITION BY event_type ORDER BY ts, event_id), 2) AS volume FROM s")
def outflow_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", micros(F.col("ts")) / 1e6)
    return bodies.outflow(e, ["event_type"], ["t", "event_id"], "t", F.col("value")).select("event_id", r(F.col("volume"), 2).alias("volume"))


@query("WITH a AS (SELECT DISTINCT user_id, (event_id * 73 % 3600)/10.0 AS a FROM events) SELECT user_id, round(max(gap), 6) AS gap FROM (SELECT user_id, coalesce(a - lag(a) OVER (PARTITION BY user_id ORDER BY a), a + 360 - max(a) OVER (PARTITION BY user_id)) AS gap FROM a) GROUP BY 1")
def angular_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", ((F.col("event_id") * 73 % 3600) / 10.0).alias("a")).distinct()
    return bodies.largest_gap(e, ["user_id"], "a").select("user_id", r(F.col("gap")).alias("gap"))


@query("SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median, min(l_quantity) AS least, round(sum(l_extendedprice), 2) AS area FROM lineitem GROUP BY 1")
def upper_median_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(bodies.upper_median("l_quantity").alias("median"), F.min("l_quantity").alias("least"), r(F.sum("l_extendedprice"), 2).alias("area"))


@query("SELECT p_brand, round(sum(p_retailprice), 3) AS weight, round(sum(p_retailprice*p_size)/sum(p_retailprice), 6) AS c_p_size, min(p_size) AS min_p_size, max(p_size) AS max_p_size FROM part GROUP BY 1")
def weighted_centroid_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bodies.weighted_centroid(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_retailprice"), ["p_size"])
    return out.select("p_brand", r(F.col("weight"), 3).alias("weight"), r(F.col("c_p_size")).alias("c_p_size"), "min_p_size", "max_p_size")


@query("SELECT l_partkey % 50 AS cell, round(sum(l_discount*l_quantity)/sum(l_quantity), 6) AS mean, arg_max(l_orderkey*8 + l_linenumber, l_quantity*1e9 - (l_orderkey*8 + l_linenumber)) AS node, round_even(255*sum(l_discount*l_quantity)/sum(l_quantity), 0)::INT AS q FROM lineitem GROUP BY 1")
def display_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume-weighted mean, the heaviest node (the first on ties) and the quantised field of display cells."""
    node = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").withColumn("cell", F.col("l_partkey") % 50)
    return bodies.resampled(li, ["cell"], F.col("l_discount"), F.col("l_quantity"), node).withColumn("mean", r(F.col("mean")))


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1"""
)
def pocket_history_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column a box, a row a day."""
    return bodies.history(table(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd"), "day", "event_type", ["click", "purchase", "view"])


@query(
    """WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_totalprice > 10000)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS what FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice"""
)
def recording_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recordings of the orders compared key by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    b = o.filter("o_totalprice > 10000").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return bodies.differences(o.filter("o_orderpriority <> '5-LOW'"), b, ["o_orderkey"], ["o_totalprice"])


@query("SELECT l_orderkey, bool_or(l_discount < 0.02) AS air_a, bool_or(l_tax < 0.02) AS air_b, bool_or(l_discount < 0.02 AND l_tax < 0.02) AS \"both\" FROM lineitem GROUP BY 1")
def throat_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether air stands at either side of a throat, and at both sides of one of its faces."""
    return bodies.throat_air(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_discount") < 0.02, F.col("l_tax") < 0.02)


@query("SELECT l_suppkey, arg_max(l_partkey, l_quantity*1e9 - l_partkey) AS body, max(l_quantity) AS level FROM lineitem GROUP BY 1")
def side_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest body that touches a side, the lowest id on ties."""
    return bodies.side_bodies(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / count(*) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def merge_share_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bodies.equal_shares(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity"))
    return out.select("l_orderkey", "l_linenumber", r(F.col("share")).alias("share"))
