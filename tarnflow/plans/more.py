"""Filters, links and views of cells, on fields made of the given tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.operators import bodies, cells, near
from tarnflow.plans.flow import _FIELD, _FIELD_LINKS, field
from tarnflow.plans.registry import micros, query, r, table
from tarnflow.sources import motion, scenes
from tarnflow.sources.scenes import Raster

BOX = Raster((1 << 40, 9, 8), 1.0, (0.0, 0.0, 0.0))
_BOX = "(SELECT o_orderkey AS node_id, o_orderkey // 72 AS i, (o_orderkey // 8) % 9 AS j, o_orderkey % 8 AS k, o_custkey % 100 < 30 AS solid FROM orders)"


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raster of 9 by 8 cells and as long as there are orders, closed where the customer's number says so."""
    n = F.col("node_id")
    index = {"i": F.floor(n / 72).cast("long"), "j": (F.floor(n / 8) % 9).cast("int"), "k": (n % 8).cast("int")}
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), (F.col("o_custkey") % 100 < 30).alias("solid")).withColumns(index)
    return cells.withColumns({c: F.col(a) + 0.5 for c, a in zip("xyz", "ijk", strict=True)})


@query("SELECT p_partkey, s.range::INT AS n, round(p_size + p_retailprice/1000*cos(radians(15.0*s.range)), 6) AS x, round(p_partkey % 7 + p_retailprice/1000*sin(radians(15.0*s.range)), 6) AS y FROM part, range(24) s")
def hole_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round holes as polygons of 24 corners."""
    p = table(spark, sf_dir, "part").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(23))))
    x, y = G.on_circle((F.col("p_size"), F.col("p_partkey") % 7), F.col("p_retailprice") / 1000, F.col("n"), 24)
    return p.select("p_partkey", "n", r(x).alias("x"), r(y).alias("y"))


_TRI = "(SELECT p_partkey, (p_partkey % 17)/4.0 AS ax, (p_partkey % 13)/4.0 AS ay, (p_partkey % 11)/4.0 AS az, (p_partkey % 7)/2.0 + 1 AS bx, (p_size % 5)/2.0 AS \"by\", (p_size % 3)/2.0 AS bz, (p_size % 11)/3.0 AS cx, (p_partkey % 5) + 2.0 AS cy, (p_size % 13)/5.0 AS cz FROM part)"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle a part."""
    k, s = F.col("p_partkey"), F.col("p_size")
    at = {"ax": (k % 17) / 4.0, "ay": (k % 13) / 4.0, "az": (k % 11) / 4.0, "bx": (k % 7) / 2.0 + 1, "by": (s % 5) / 2.0, "bz": (s % 3) / 2.0, "cx": (s % 11) / 3.0, "cy": (k % 5) + 2.0, "cz": (s % 13) / 5.0}
    return table(spark, sf_dir, "part").select(k.alias("face_id"), *(v.cast("double").alias(n) for n, v in at.items()))


@query(
    f"""WITH n AS (SELECT *, ("by"-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - ("by"-ay)*(cx-ax) AS nz FROM {_TRI}), l AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM n)
    SELECT p_partkey AS face_id, round((ax+bx+cx)/3, 6) AS x, round((ay+"by"+cy)/3, 6) AS y, round((az+bz+cz)/3, 6) AS z, round(CASE WHEN l > 0 THEN nx/l END, 6) AS nx, round(CASE WHEN l > 0 THEN ny/l END, 6) AS ny, round(CASE WHEN l > 0 THEN nz/l END, 6) AS nz, round(l/2, 6) AS area FROM l"""
)
def face_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid, normal and area of the parts' triangles."""
    corners = [[F.col(f"{v}{c}") for c in "xyz"] for v in "abc"]
    centroid, normal, area = G.face_geometry(*corners)
    names = ("x", "y", "z", "nx", "ny", "nz", "area")
    return triangles(spark, sf_dir).select("face_id", *(r(c).alias(n) for n, c in zip(names, [*centroid, *normal, area], strict=True)))


@query(
    f"""WITH q AS (SELECT *, 2.0 + (p_partkey % 3) AS qx, 1.5 AS qy, -1.0 AS qz, 0.0 AS dx, 0.1 AS dy, 6.0 AS dz FROM {_TRI}), e AS (SELECT *, bx-ax AS e1x, "by"-ay AS e1y, bz-az AS e1z, cx-ax AS e2x, cy-ay AS e2y, cz-az AS e2z, qx-ax AS sx, qy-ay AS sy, qz-az AS sz FROM q),
    h AS (SELECT *, dy*e2z - dz*e2y AS hx, dz*e2x - dx*e2z AS hy, dx*e2y - dy*e2x AS hz, sy*e1z - sz*e1y AS kx, sz*e1x - sx*e1z AS ky, sx*e1y - sy*e1x AS kz FROM e), d AS (SELECT *, e1x*hx+e1y*hy+e1z*hz AS det FROM h),
    u AS (SELECT *, CASE WHEN det <> 0 THEN (sx*hx+sy*hy+sz*hz)/det END AS u, CASE WHEN det <> 0 THEN (dx*kx+dy*ky+dz*kz)/det END AS v, CASE WHEN det <> 0 THEN (e2x*kx+e2y*ky+e2z*kz)/det END AS t FROM d)
    SELECT p_partkey AS face_id, coalesce(u >= -1e-9 AND v >= -1e-9 AND u+v <= 1+1e-9 AND t BETWEEN -1e-9 AND 1+1e-9, false) AS crosses, round(CASE WHEN u >= -1e-9 AND v >= -1e-9 AND u+v <= 1+1e-9 AND t > 1e-9 THEN t END, 6) AS t FROM u"""
)
def sight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a segment crosses a part's triangle, and where the ray along it does."""
    corners = [[F.col(f"{v}{c}") for c in "xyz"] for v in "abc"]
    p = [2.0 + (F.col("face_id") % 3), F.lit(1.5), F.lit(-1.0)]
    d = [F.lit(0.0), F.lit(0.1), F.lit(6.0)]
    return triangles(spark, sf_dir).select("face_id", G.segment_meets_triangle(p, G.plus(p, d), *corners).alias("crosses"), r(G.ray_distance(p, d, *corners)).alias("t"))


@query(
    f"""WITH n AS (SELECT *, h % 97 = 5 AND NOT sink AS src FROM {_FIELD}), t AS (SELECT max(h) AS top FROM n WHERE src)
    SELECT node_id FROM n, t WHERE CASE WHEN top IS NULL THEN sink ELSE h <= top END"""
)
def band_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the poured liquid can reach: none above its highest source; sinks only if nothing is poured."""
    nodes, _ = field(spark, sf_dir)
    n = nodes.withColumn("src", (F.col("h") % 97 == 5) & ~F.col("sink"))
    top = n.filter("src").agg(F.max("h").alias("top"))
    return n.crossJoin(F.broadcast(top)).filter(F.when(F.col("top").isNull(), F.col("sink")).otherwise(F.col("h") <= F.col("top"))).select("node_id")


@query(f"SELECT n.node_id FROM {_FIELD} n WHERE sink AND NOT EXISTS (SELECT 1 FROM {_FIELD_LINKS} l JOIN {_FIELD} m ON m.node_id = l.dst WHERE l.src = n.node_id AND NOT m.sink)")
def prune_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks among sinks only: they take no part, what is poured on them is gone."""
    nodes, links = field(spark, sf_dir)
    dry = nodes.filter("not sink").select(F.col("node_id").alias("dst"))
    near_dry = links.join(dry, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
    return nodes.filter("sink").join(near_dry, "node_id", "left_anti").select("node_id")


_VEC = "(SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"


@query(f"SELECT vec_id FROM {_VEC} t WHERE label > 0 AND NOT EXISTS (SELECT 1 FROM {_VEC} h WHERE h.label = 0 AND sqrt((h.x-t.x)^2+(h.y-t.y)^2+(h.z-t.z)^2) <= 0.05*(1 + h.vec_id % 3)) AND vec_id // 4 NOT IN (SELECT vec_id // 4 FROM {_VEC} WHERE abs(x) < 0.01)")
def throats_not_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throats that touch no used cell and lie farther from every forced hole than its diameter."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")), "label", F.floor(F.col("vec_id") / 4).alias("cell"))
    holes = v.filter("label = 0").withColumn("radius", 0.05 * (1 + F.col("vec_id") % 3))
    used = v.filter("abs(x) < 0.01").select("cell").distinct()
    t = v.filter("label > 0")
    return t.join(near.inside_any(t, "vec_id", holes, "xyz", 0.15), "vec_id", "left_anti").join(used, "cell", "left_anti").select("vec_id")


_STEP26 = "(SELECT a.range - 1 AS a, b.range - 1 AS b, c.range - 1 AS c FROM range(3) a, range(3) b, range(3) c)"


@query(f"SELECT x.node_id AS src, y.node_id AS dst FROM {_BOX} x JOIN {_STEP26} s ON abs(a)+abs(b)+abs(c) > 1 JOIN {_BOX} y ON y.i = x.i+a AND y.j = x.j+b AND y.k = x.k+c WHERE NOT x.solid AND NOT y.solid AND x.node_id < y.node_id")
def links26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links over edges and corners, once each."""
    return cells.links_by(box(spark, sf_dir).filter("not solid").select("node_id", "i", "j", "k"), cells.CORNER_STEPS, half=True)


@query(
    f"""WITH c AS MATERIALIZED (SELECT * FROM {_BOX}), cut AS (SELECT DISTINCT x.* FROM c x JOIN {_STEP26} t ON abs(a)+abs(b)+abs(t.c) = 1 JOIN c y ON y.i = x.i+a AND y.j = x.j+b AND y.k = x.k+t.c WHERE x.solid AND NOT y.solid),
    s AS (SELECT node_id AS host, i*2+a.range AS i, j*2+b.range AS j, k*2+d.range AS k FROM cut, range(2) a, range(2) b, range(2) d)
    SELECT count(*) AS subcells, count(DISTINCT host) AS hosts, sum(i*10000 + j*100 + k)::BIGINT AS ids FROM s"""
)
def cut_subcells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed cells next to open ones, as eight sub-cells each."""
    b = box(spark, sf_dir)
    faces = cells.links_by(b.select("node_id", "i", "j", "k"), [s for s in cells.ALL_STEPS if sum(map(abs, s)) == 1])
    sub = cells.subcells(cells.cut_cells(b, faces), 2)
    return sub.agg(F.count(F.lit(1)).alias("subcells"), F.countDistinct("host").alias("hosts"), F.sum(F.col("i") * 10000 + F.col("j") * 100 + F.col("k")).cast("long").alias("ids"))


_FACES = f"JOIN {_STEP26} t ON abs(a)+abs(b)+abs(t.c) = 1"


@query(
    f"""WITH c AS (SELECT * FROM {_BOX}), s AS (SELECT (node_id*8 + a.range*4 + b.range*2 + d.range)::BIGINT AS id, i*2+a.range AS i, j*2+b.range AS j, k*2+d.range AS k FROM c, range(2) a, range(2) b, range(2) d WHERE solid AND (node_id*8 + a.range*4 + b.range*2 + d.range) % 3 <> 0)
    SELECT 'fine' AS kind, x.id AS src, y.id AS dst FROM s x {_FACES} JOIN s y ON y.i = x.i+a AND y.j = x.j+b AND y.k = x.k+t.c WHERE x.id < y.id
    UNION ALL SELECT 'coarse', x.id, c.node_id FROM s x JOIN {_STEP26} t ON abs(a)+abs(b)+abs(t.c) = 1 JOIN c ON NOT c.solid AND c.i = (x.i+a)//2 AND c.j = (x.j+b)//2 AND c.k = (x.k+t.c)//2 AND x.i+a >= 0 AND x.j+b >= 0 AND x.k+t.c >= 0"""
)
def subcell_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of open sub-cells, among each other and to open cells."""
    b = box(spark, sf_dir)
    s = cells.subcells(b.filter("solid"), 2)
    s = s.withColumn("id", F.col("host") * 8 + F.col("i") % 2 * 4 + F.col("j") % 2 * 2 + F.col("k") % 2).filter("id % 3 <> 0")
    return cells.fine_links(s, b.filter("not solid"), 2).select("kind", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query("WITH p AS (SELECT DISTINCT l_orderkey AS id, l_suppkey % 25 AS label FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM p) SELECT label, round(sum(0.125/n), 6) AS volume FROM n GROUP BY 1")
def shared_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sub-cells shared in equal parts by the labels next to them."""
    li = table(spark, sf_dir, "lineitem")
    near_ = li.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 25).alias("label"))
    solid = li.select(F.col("l_orderkey").alias("id")).distinct()
    return cells.shared_volumes(solid, near_, 0.125).select("label", r(F.col("volume")).alias("volume"))


@query(
    """WITH n AS (SELECT p_partkey, (p_partkey % 10)*4 + 2.0 AS x, (p_partkey // 10 % 10)*4 + 2.0 AS y, (p_partkey // 100 % 2)*4 + 2.0 AS z, p_size/50.0 AS f, CASE WHEN p_partkey % 3 = 0 THEN 4.0 ELSE 1.0 END AS s FROM part),
    c AS (SELECT n.*, a.range AS i, b.range AS j, d.range AS k FROM n, range(20) a, range(20) b, range(4) d WHERE CASE WHEN s > 2 THEN a.range*2 < x+s/2 AND a.range*2+2 > x-s/2 AND b.range*2 < y+s/2 AND b.range*2+2 > y-s/2 AND d.range*2 < z+s/2 AND d.range*2+2 > z-s/2
    ELSE a.range = floor(x/2) AND b.range = floor(y/2) AND d.range = floor(z/2) END) SELECT i::INT AS i, j::INT AS j, k::INT AS k, round(sum(f*power(least(s, 2), 3))/sum(power(least(s, 2), 3)), 6) AS f FROM c GROUP BY 1, 2, 3"""
)
def display_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse and fine nodes spread over a display grid of cells of size 2."""
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select(((k % 10) * 4 + 2.0).alias("x"), ((F.floor(k / 10) % 10) * 4 + 2.0).alias("y"), ((F.floor(k / 100) % 2) * 4 + 2.0).alias("z"), (F.col("p_size") / 50.0).alias("f"), F.when(k % 3 == 0, 4.0).otherwise(1.0).alias("size"))
    return cells.spread(n, "f", 2.0, (0, 0, 0), (20, 20, 4)).select("i", "j", "k", r(F.col("f")).alias("f"))


@query(f"SELECT x.node_id, max(y.node_id % 17)::INT AS f FROM {_BOX} x JOIN {_BOX} y ON abs(x.i-y.i) <= 1 AND abs(x.j-y.j) <= 1 AND abs(x.k-y.k) <= 1 WHERE x.solid AND NOT y.solid GROUP BY 1")
def dilate_into_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box(spark, sf_dir).withColumn("f", (F.col("node_id") % 17).cast("int"))
    return cells.into_solid(b.filter("not solid"), b.filter("solid"), "f")


@query(f"SELECT (i//2*100 + j//2*10 + k//2)::BIGINT AS host, max(node_id % 17)::INT AS f FROM {_BOX} WHERE NOT solid GROUP BY 1")
def grid_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-cells folded into their hosts by the maximum."""
    host = sum((F.shiftright(F.col(a), 1) * w for a, w in zip("ijk", (100, 10, 1), strict=True)), F.lit(0))
    return box(spark, sf_dir).filter("not solid").groupBy(host.cast("long").alias("host")).agg(F.max((F.col("node_id") % 17).cast("int")).alias("f"))


@query("WITH e AS (SELECT user_id, event_id, value, sum(CASE WHEN coalesce(event_type <> lag_, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS lag_ FROM events)) SELECT user_id, run::BIGINT AS run, min(event_id) AS \"first\", count(*) AS n FROM e GROUP BY 1, 2")
def sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal neighbours in order: where each begins and how long it is."""
    return bodies.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query(
    """WITH c AS (SELECT user_id, epoch_us(ts)//1000000 AS t, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT user_id, t, sum(v) OVER (PARTITION BY user_id ORDER BY t) AS v FROM c),
    s AS (SELECT *, (SELECT arg_min(q.v, q.t) FROM r q WHERE q.user_id = r.user_id AND q.t BETWEEN r.t - 100000 AND r.t) AS then_, min(t) OVER (PARTITION BY user_id) AS t0 FROM r)
    SELECT user_id, min(t) AS t FROM s WHERE t - t0 >= 100000 AND abs(v - then_) <= 0.2*greatest(abs(v), 1e-12) GROUP BY 1"""
)
def adaptive_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's total has changed by less than a fifth over the last 100000 seconds."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.floor(micros(F.col("ts")) / 1000000).alias("t")).agg(F.sum("value").alias("v"))
    e = e.withColumn("v", F.sum("v").over(W.partitionBy("user_id").orderBy("t")))
    return bodies.settled(e, ["user_id"], "t", "v", 100000, 0.2)


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 3 AS n, 0.25*(1 + o_orderkey % 4) AS rate FROM orders), f AS (SELECT o_custkey, o_orderkey, unnest(range(1, n + 1)) AS s, rate FROM p)
    SELECT o_custkey, row_number() OVER w AS frame, row_number() OVER w * 0.5::DOUBLE AS t, sum(rate * 0.5) OVER w::DOUBLE AS movie FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey, s ROWS UNBOUNDED PRECEDING)"""
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as phases of a film: frames of half a second, with model time and film time since the first."""
    k = F.col("o_orderkey")
    phases = table(spark, sf_dir, "orders").select("o_custkey", k.alias("phase"), ((1 + k % 3) * 0.5).alias("length"), F.lit(0.5).alias("step"), (0.25 * (1 + k % 4)).alias("rate"))
    return motion.frames(phases, ["o_custkey"], "phase").select("o_custkey", "frame", "t", "movie")


@query(
    """WITH p AS (SELECT event_id, radians((event_id*37) % 360) AS a, (event_id % 50)/10.0 AS s FROM events), c AS (SELECT * FROM (VALUES (-1.0), (2.0)) x(x), (VALUES (-0.5), (0.5)) y(y), (VALUES (0.0), (1.5)) z(z))
    SELECT round(min(x), 6) AS lo_x, round(min(y*cos(a) - z*sin(a)), 6) AS lo_y, round(min(y*sin(a) + z*cos(a) - s), 6) AS lo_z, round(max(x), 6) AS hi_x, round(max(y*cos(a) - z*sin(a)), 6) AS hi_y, round(max(y*sin(a) + z*cos(a) - s), 6) AS hi_z FROM p, c"""
)
def world_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box that an object's corners sweep over all poses: eight corners a pose."""
    e = F.col("event_id")
    poses = table(spark, sf_dir, "events").select(((e * 37) % 360).cast("double").alias("ax"), (-(e % 50) / 10.0).alias("sz"))
    corner = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x in (-1.0, 2.0) for y in (-0.5, 0.5) for z in (0.0, 1.5))))
    df = poses.select("ax", "sz", corner.alias("c"))
    world = G.to_world([F.col(f"c.{c}") for c in "xyz"], [F.col("ax"), 0.0, 0.0], [0.0, 0.0, F.col("sz")], (0.0, 0.0, 0.0))
    return df.agg(*(r(F.min(w)).alias(f"lo_{c}") for w, c in zip(world, "xyz", strict=True)), *(r(F.max(w)).alias(f"hi_{c}") for w, c in zip(world, "xyz", strict=True)))


@query("SELECT l_suppkey % 20 AS lab, count(*) FILTER (l_quantity > 25) AS wet, round(coalesce(sum(l_quantity*l_tax) FILTER (l_discount >= 0.02), 0), 4) AS source, round(max(l_extendedprice) FILTER (l_discount >= 0.02), 2) AS top, round(min(l_extendedprice), 2) AS low FROM lineitem GROUP BY 1")
def sweep_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, wet cells and height range that a settling sweep starts from, a compartment each."""
    lab, poured = F.col("l_suppkey") % 20, F.col("l_quantity") * F.col("l_tax")
    out = bodies.sweep_inputs(table(spark, sf_dir, "lineitem"), lab, F.col("l_quantity") > 25, F.col("l_discount") >= 0.02, poured, "l_extendedprice")
    return out.select("lab", "wet", r(F.col("source"), 4).alias("source"), r(F.col("top"), 2).alias("top"), r(F.col("low"), 2).alias("low"))


@query(
    f"""WITH c AS (SELECT * FROM {_BOX}), f AS (SELECT x.node_id AS src, y.node_id AS dst, (x.i+y.i)/2.0+0.5 AS mx, (x.j+y.j)/2.0+0.5 AS my, (x.k+y.k)/2.0+0.5 AS mz, x.i+0.5 AS ai, y.i+0.5 AS bi FROM c x {_FACES} JOIN c y ON y.i = x.i+a AND y.j = x.j+b AND y.k = x.k+t.c WHERE x.node_id < y.node_id AND NOT x.solid AND NOT y.solid)
    SELECT h.hole_id, src, dst FROM f JOIN (SELECT s_suppkey AS hole_id, s_suppkey*2 + 0.9 AS x, s_nationkey % 9 + 0.5 AS y, s_suppkey % 8 + 0.5 AS z, 2.0 + s_suppkey % 3 AS d FROM supplier) h ON (ai-x)*(bi-x) <= 0 AND ai <> bi AND sqrt((my-y)^2+(mz-z)^2) <= d/2 + 0.5"""
)
def hole_throats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that cross the middle planes of the suppliers' holes."""
    b = box(spark, sf_dir)
    n, one, none = F.col("s_suppkey"), F.lit(1.0), F.lit(0.0)
    holes = table(spark, sf_dir, "supplier").select(n.alias("hole_id"), (n * 2 + 0.9).alias("x"), (F.col("s_nationkey") % 9 + 0.5).alias("y"), (n % 8 + 0.5).alias("z"), one.alias("ax"), none.alias("ay"), none.alias("az"), (2.0 + n % 3).alias("diameter"))
    return cells.crossing_plane(scenes.face_links(BOX, b).filter("src < dst"), b, holes, 0.5)


@query("SELECT p_partkey, round(p_retailprice*101325/(101325 + 9810*(p_size/10.0)), 6) AS v FROM part")
def boyle_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gas at the depth of a part's size in decimetres."""
    from tarnflow.functions import physics as P
    from tarnflow.operators.pressure import boyle_volume as boyle

    here = P.hydrostatic(-F.col("p_size") / 10.0, F.lit(0.0))
    return table(spark, sf_dir, "part").select("p_partkey", r(boyle(F.col("p_retailprice"), here)).alias("v"))


