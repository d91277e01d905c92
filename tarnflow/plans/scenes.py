"""Rasters, shapes, poses and the scalar laws, on scenes and on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.functions import physics as P
from tarnflow.operators.session import spread
from tarnflow.plans.registry import micros, query, r, table
from tarnflow.sources import motion, scenes
from tarnflow.sources.scenes import Raster

#: A part's raster: cells and their size.
DIMS, DX = (8, 6, 5), 0.125
_CELLS = """(SELECT p_partkey, p_size/50.0 AS s, p_partkey % 7 AS m, c.range AS node_id, (c.range // 30)::INT AS i, ((c.range // 5) % 6)::INT AS j, (c.range % 5)::INT AS k, (c.range // 30 + 0.5)*0.125::DOUBLE AS x, ((c.range // 5) % 6 + 0.5)*0.125::DOUBLE AS y,
 (c.range % 5 + 0.5)*0.125::DOUBLE AS z FROM part, range(240) c)"""
_COUNTED = "count(*) AS cells, sum(node_id)::BIGINT AS ids"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as shapes: their size (up to 1) and a number from 0 to 6; dealt to all tasks, for a part becomes a raster of cells."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("s"), (F.col("p_partkey") % 7).alias("m")), "p_partkey")


def _point() -> list[Column]:
    return [F.col(c) for c in "xyz"]


def counted(spark: SparkSession, sf_dir: str, inside: Column) -> DataFrame:
    """How many cells each part's shape fills, and the sum of their numbers."""
    # Counted, not filtered: a filter would be pushed below the centres and repeat their arithmetic wherever a shape names them.
    cells = scenes.filled(parts(spark, sf_dir), DIMS, DX, inside).select("p_partkey", "node_id", "solid")
    return cells.groupBy("p_partkey").agg(F.count_if("solid").alias("cells"), F.sum(F.when(F.col("solid"), F.col("node_id"))).alias("ids")).filter("cells > 0")


@query(f"SELECT p_partkey, node_id, i, j, k, x + m AS x, y, z FROM {_CELLS}")
def raster_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each part's raster, parts side by side in seven places."""
    cells = scenes.filled(parts(spark, sf_dir), DIMS, DX, F.lit(False))
    return cells.select("p_partkey", "node_id", "i", "j", "k", (F.col("x") + F.col("m")).alias("x"), "y", "z")


@query(f"SELECT p_partkey, {_COUNTED} FROM {_CELLS} WHERE (i IN (0, 7) OR j IN (0, 5) OR k IN (0, 4)) AND x > s/2 GROUP BY 1")
def boundary_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on the boundary of each part's raster, beyond half its size."""
    return counted(spark, sf_dir, G.on_boundary([F.col(a) for a in "ijk"], DIMS) & (F.col("x") > F.col("s") / 2))


@query(
    f"""WITH f AS MATERIALIZED (SELECT * FROM {_CELLS} WHERE sqrt((x-0.5)^2 + (y-0.375)^2 + (z-0.3125)^2) > s/2) SELECT a.p_partkey, count(*) AS links, sum(a.node_id * b.node_id)::BIGINT AS ids
    FROM f a JOIN (VALUES (-30), (-5), (-1), (1), (5), (30)) v(v) ON true JOIN f b ON b.p_partkey = a.p_partkey AND b.node_id = a.node_id + v.v WHERE abs(a.i-b.i) + abs(a.j-b.j) + abs(a.k-b.k) = 1 GROUP BY 1"""
)
def face_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the cells outside a ball of each part's size: numbers of a part's cells run on from the part before."""
    ball = lambda p: G.in_ball(p, (0.5, 0.375, 0.3125), F.col("s") / 2)
    size = Raster(DIMS, DX, (0.0, 0.0, 0.0))
    links = parts(spark, sf_dir).crossJoin(F.broadcast(scenes.face_pairs(spark, size))).filter(~ball(size.at()) & ~ball([F.col(f"to_{p}") for p in size.points]))
    return links.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("links"), F.sum(F.col("src") * F.col("dst")).alias("ids"))


@query(f"SELECT p_partkey, {_COUNTED} FROM {_CELLS} WHERE x BETWEEN 0.1 AND 0.3 + s/2 AND y BETWEEN 0.05*m AND 0.6 AND z BETWEEN 0.1 AND 0.5 GROUP BY 1")
def shape_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, G.in_box(_point(), (0.1, 0.05 * F.col("m"), 0.1), (0.3 + F.col("s") / 2, 0.6, 0.5)))


@query(f"SELECT p_partkey, {_COUNTED} FROM {_CELLS} WHERE sqrt((x-0.1*m)^2 + (y-0.35)^2 + (z-0.3)^2) <= 0.1 + s/2 GROUP BY 1")
def shape_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, G.in_ball(_point(), (0.1 * F.col("m"), 0.35, 0.3), 0.1 + F.col("s") / 2))


def _axis() -> tuple[list[Column], list[Column]]:
    return [F.lit(0.2), F.lit(0.1), 0.05 * F.col("m")], [F.lit(0.8), 0.1 + F.col("s") / 2, F.lit(0.45)]


_WAY = "0.6 AS dx, s/2 AS dy, 0.45 - 0.05*m AS dz"
_FOOT = "((x-0.2)*dx + (y-0.1)*dy + (z-0.05*m)*dz) / (dx*dx + dy*dy + dz*dz)"
_OFF = "sqrt((x-0.2-t*dx)^2 + (y-0.1-t*dy)^2 + (z-0.05*m-t*dz)^2)"


@query(f"WITH w AS (SELECT *, {_WAY} FROM {_CELLS}), f AS (SELECT *, greatest(0, least(1, {_FOOT})) AS t FROM w) SELECT p_partkey, {_COUNTED} FROM f WHERE {_OFF} <= 0.15 GROUP BY 1")
def shape_capsule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, G.in_capsule(_point(), *_axis(), 0.15))


@query(f"WITH w AS (SELECT *, {_WAY} FROM {_CELLS}), f AS (SELECT *, {_FOOT} AS t FROM w) SELECT p_partkey, {_COUNTED} FROM f WHERE t BETWEEN 0 AND 1 AND {_OFF} <= 0.18 GROUP BY 1")
def shape_cylinder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, G.in_cylinder(_point(), *_axis(), 0.18))


@query(
    f"""WITH f AS (SELECT *, greatest(0, least(1, (x-0.1)/0.6)) AS t, CASE WHEN s > 0 THEN greatest(0, least(1, (y-0.1)/s)) ELSE 0 END AS u, 1.01*sqrt(3*0.0625*0.0625) AS r FROM {_CELLS})
    SELECT p_partkey, {_COUNTED} FROM f WHERE sqrt((x-0.1-t*0.6)^2 + (y-0.1)^2 + (z-0.25)^2) <= r OR sqrt((x-0.7)^2 + (y-0.1-u*s)^2 + (z-0.25)^2) <= r GROUP BY 1"""
)
def shape_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with a bend, as thin as leaves no gap."""
    line = [(0.1, 0.1, 0.25), (0.7, 0.1, 0.25), (0.7, 0.1 + F.col("s"), 0.25)]
    return counted(spark, sf_dir, G.in_polyline(_point(), line, G.tightest(3, DX)))


@query(
    f"""SELECT p_partkey, {_COUNTED} FROM {_CELLS} WHERE x BETWEEN 0.05 AND 0.45 + s/2 AND y BETWEEN 0.05 AND 0.7 AND z BETWEEN 0.05 AND 0.6
    AND (x - 0.05 < 0.03*m OR 0.45 + s/2 - x < 0.03*m OR y - 0.05 < 0.03*m OR 0.7 - y < 0.03*m OR z - 0.05 < 0.03*m) GROUP BY 1"""
)
def shape_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box without a lid; its walls are thicker for some parts than for others."""
    return counted(spark, sf_dir, G.in_shell(_point(), (0.05, 0.05, 0.05), (0.45 + F.col("s") / 2, 0.7, 0.6), 0.03 * F.col("m"), [(2, 1)]))


# ---- keys, poses, heights


@query("SELECT o_orderkey, (((o_orderkey % 64) * 32 + (o_custkey % 32)) * 16 + o_orderkey % 16)::BIGINT AS key, (o_orderkey % 64 // 2)::INT AS pi, (o_custkey % 32 // 2)::INT AS pj, (o_orderkey % 16 // 2)::INT AS pk, (((o_orderkey % 64 // 2) * 16 + (o_custkey % 32 // 2)) * 8 + o_orderkey % 16 // 2)::BIGINT AS parent FROM orders")
def octree_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cells, back to coordinates, and the parent's key one level up."""
    dims = (64, 32, 16)
    index = [(F.col("o_orderkey") % 64).cast("int"), (F.col("o_custkey") % 32).cast("int"), (F.col("o_orderkey") % 16).cast("int")]
    df = table(spark, sf_dir, "orders").select("o_orderkey", G.flat_key(index, dims).alias("key"))
    up = [F.shiftright(c, 1) for c in G.coords_of(F.col("key"), dims)]
    df = df.withColumns(dict(zip(("pi", "pj", "pk"), up, strict=True)))
    return df.withColumn("parent", G.flat_key([F.col(c) for c in ("pi", "pj", "pk")], G.dims_at(dims, 1)))


@query(
    """WITH e AS (SELECT event_id, radians((event_id*37) % 360) AS a, radians((event_id*11) % 90) AS b, radians((event_id*53) % 360) AS c, (event_id % 100)/10.0 AS s FROM events),
    u AS (SELECT *, -sin(b) AS ux, cos(b)*sin(a) AS uy, cos(b)*cos(a) AS uz FROM e)
    SELECT event_id, round(ux, 6) AS ux, round(uy, 6) AS uy, round(uz, 6) AS uz, round(-0.5 - (0.3 + s) + (0.1*ux + 0.2*uy + 0.3*uz), 6) AS zb,
    round(0.5*0.02*(abs(ux)+abs(uy)+abs(uz)), 9) AS half, round_even((1.25*ux - 0.75*uy + 0.5*uz)*1e9, 0)::BIGINT // 1000 AS h_um FROM u"""
)
def pose_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up vector, bath height, half extent and height of poses taken from the events."""
    e = F.col("event_id")
    poses = table(spark, sf_dir, "events").select("event_id", ((e * 37) % 360).cast("double").alias("ax"), ((e * 11) % 90).cast("double").alias("ay"), ((e * 53) % 360).cast("double").alias("az"), ((e % 100) / 10.0).alias("sz"))
    f = motion.frames_at(poses, (0.1, 0.2, 0.3), -0.5)
    up = [F.col(c) for c in ("ux", "uy", "uz")]
    h = G.height_nm([F.lit(1.25), F.lit(-0.75), F.lit(0.5)], up)
    whole = F.when(h < 0, -F.floor(-h / 1000)).otherwise(F.floor(h / 1000))
    return f.select("event_id", *(r(c).alias(n) for n, c in zip(("ux", "uy", "uz"), up, strict=True)), r(F.col("zb")).alias("zb"), r(G.half_extent(0.02, up), 9).alias("half"), whole.alias("h_um"))


@query(
    """WITH k AS (SELECT user_id, epoch_us(ts)/1e6 AS t, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1, min(t) OVER (PARTITION BY user_id) AS t_min, max(t) OVER (PARTITION BY user_id) AS t_max FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    q AS (SELECT user_id, floor(min(t)) + (max(t) - min(t)) * g.range / 4 + 0.5 AS "at" FROM k, range(-1, 6) g GROUP BY user_id, g.range)
    SELECT q.user_id, g.n::INT AS n, round(CASE WHEN q."at" < s.t_min THEN first_v ELSE v + coalesce((v1 - v) * (q."at" - s.t) / (t1 - s.t), 0) END, 5) AS v
    FROM (SELECT user_id, "at", row_number() OVER (PARTITION BY user_id ORDER BY "at") AS n FROM q) g JOIN q USING (user_id, "at")
    JOIN (SELECT *, first_value(v) OVER (PARTITION BY user_id ORDER BY t) AS first_v FROM s) s ON s.user_id = q.user_id
    AND ((q."at" >= s.t AND (s.t1 IS NULL OR q."at" < s.t1)) OR (q."at" < s.t_min AND s.t = s.t_min))"""
)
def pose_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values as keyframes, interpolated at seven times before, between and after them."""
    k = table(spark, sf_dir, "events").groupBy("user_id", (micros(F.col("ts")) / 1e6).alias("t")).agg(F.avg("value").alias("v"))
    span = k.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    times = span.select("user_id", F.explode(F.sequence(F.lit(-1), F.lit(5))).alias("g"), "lo", "hi").select("user_id", (F.floor("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / 4 + 0.5).alias("at"))
    out = motion.interpolated(k, times, ["user_id"], "t", ["v"])
    from pyspark.sql import Window as W

    return out.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("at")).alias("n"), r(F.col("v"), 5).alias("v"))


@query(
    """WITH a AS (SELECT user_id, event_id, ((event_id*131) % 360)::DOUBLE AS a FROM events), d AS (SELECT *, a - lag(a) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM a)
    SELECT user_id, event_id, round(sum(coalesce(d - 360*floor((d+180)/360), a)) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS a FROM d"""
)
def angle_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles that go the short way from each frame to the next."""
    df = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 131) % 360).cast("double").alias("a"))
    return motion.unwrapped(df, "user_id", "event_id", "a").select("user_id", "event_id", r(F.col("a")).alias("a"))


# ---- scalar laws on parts as openings


_D = "(p_size/1000.0)"


@query(
    f"""WITH l AS (SELECT sqrt(0.072/9810.0) AS lc) SELECT p_partkey, round(4*0.072/(9810.0*{_D}), 9) AS holdup, round(CASE WHEN p_partkey % 2 = 0 THEN 3.68*lc ELSE pi()*lc END, 9) AS d_crit,
    round(CASE WHEN s <= 0 THEN 3.68*lc ELSE least(3.68*lc, 2*lc/sqrt(s)) END, 9) AS d_crit_tilted, round(CASE WHEN h > 0 THEN 0.6*pi()/4*{_D}*{_D}*sqrt(2*9.81*h) ELSE 0 END, 12) AS flow,
    round(power(greatest(sqrt(0.5) - 0.6*{_D}*{_D}/0.02*sqrt(9.81/2)*(p_partkey % 50), 0), 2), 9) AS level
    FROM (SELECT *, (p_partkey % 21 - 5)/100.0 AS h, sqrt(greatest(0, 1 - power(cos(radians(p_partkey % 181 / 2.0)), 2))) AS s FROM part), l"""
)
def throat_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-up head, critical widths, orifice flow and Torricelli level for parts as openings of p_size millimetres."""
    d, k = F.col("p_size") / 1000.0, F.col("p_partkey")
    tilt = F.cos(F.radians(k % 181 / 2.0))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        r(P.holdup_head(d), 9).alias("holdup"),
        r(F.when(k % 2 == 0, P.critical_width(3)).otherwise(P.critical_width(2)), 9).alias("d_crit"),
        r(P.critical_width_tilted(tilt), 9).alias("d_crit_tilted"),
        r(P.orifice_flow(F.lit(3.141592653589793 / 4) * d * d, (k % 21 - 5) / 100.0), 12).alias("flow"),
        r(P.torricelli_level((k % 50).cast("double"), F.lit(0.5), d * d, F.lit(0.02)), 9).alias("level"),
    )


_HOLE = "(SELECT p_partkey, p_size/2000.0 AS R, (p_partkey % 11)/10.0 AS sp, 0.1 AS c0, 0.1 + (p_partkey % 23 - 11)/500.0 AS H FROM part)"


@query(
    f"""WITH y AS (SELECT *, greatest(-R, least(R, CASE WHEN sp = 0 THEN 0 ELSE (H-c0)/sp END)) AS y FROM {_HOLE}), a AS (SELECT *, greatest(R*R - y*y, 0) AS q, R*R*acos(greatest(-1, least(1, -y/R))) + y*sqrt(greatest(R*R - y*y, 0)) AS A FROM y)
    SELECT p_partkey, round(CASE WHEN sp < 1e-9 THEN (H > c0)::INT WHEN y <= -R THEN 0 ELSE A/(pi()*R*R) END, 9) AS share,
    round(CASE WHEN sp < 1e-9 THEN c0 WHEN y <= -R THEN c0 - R*sp ELSE greatest(c0 - R*sp, c0 - 2.0/3*power(q, 1.5)/greatest(A, 1e-300)*sp) END, 9) AS centroid, round(CASE WHEN sp < 1e-9 THEN c0 ELSE c0 - R*sp END, 9) AS sill FROM a"""
)
def hole_wet_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    share, middle, sill = P.wet_segment(F.lit(0.1), (k % 11) / 10.0, F.col("p_size") / 2000.0, F.lit(0.1) + (k % 23 - 11) / 500.0)
    return table(spark, sf_dir, "part").select("p_partkey", r(share, 9).alias("share"), r(middle, 9).alias("centroid"), r(sill, 9).alias("sill"))


_GL = ", ".join(f"({x!r}, {w!r})" for x, w in zip(P.GAUSS[0].tolist(), P.GAUSS[1].tolist(), strict=True))


@query(
    f"""WITH g(x, w) AS (VALUES {_GL}), h AS (SELECT *, least(CASE WHEN sp = 0 THEN 0 ELSE (H-c0)/sp END, R) AS top FROM {_HOLE}), n AS (SELECT *, pi()/4*(x+1) AS th FROM g)
    SELECT p_partkey, round(CASE WHEN any_value(sp) < 1e-9 THEN CASE WHEN any_value(H) > 0.1 THEN pi()*any_value(R)^2*sqrt(2*9.81*(any_value(H)-0.1)) ELSE 0 END WHEN any_value(top) <= -any_value(R) THEN 0
    ELSE sum(2*sqrt(greatest(R*R - power((top+R)*sin(th)^2 - R, 2), 0))*sqrt(2*9.81*greatest(H - (c0 + ((top+R)*sin(th)^2 - R)*sp), 0))*(top+R)*pi()*sin(th)*cos(th)*0.5*w) END, 9) AS flux FROM h, n GROUP BY p_partkey"""
)
def hole_flux_gl(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, radius = F.col("p_partkey"), F.col("p_size") / 2000.0
    flux = P.hole_flux(F.lit(0.1), (k % 11) / 10.0, radius, F.lit(0.1) + (k % 23 - 11) / 500.0, F.lit(3.141592653589793) * radius * radius)
    return table(spark, sf_dir, "part").select("p_partkey", r(flux, 9).alias("flux"))


_SHAPE = """(SELECT p_partkey, a/s AS a, b/s AS b, c/s AS c FROM (SELECT *, a + b + c AS s FROM (SELECT p_partkey, CASE WHEN a/s < 1e-4 THEN 0 ELSE a/s END AS a, CASE WHEN b/s < 1e-4 THEN 0 ELSE b/s END AS b, CASE WHEN c/s < 1e-4 THEN 0 ELSE c/s END AS c FROM
 (SELECT p_partkey, u[1] AS a, u[2] AS b, u[3] AS c, u[1]+u[2]+u[3] AS s FROM (SELECT p_partkey, list_reverse_sort([abs(sin(p_partkey)) + 0.05, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE abs(cos(p_partkey*0.7)) END, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE abs(sin(p_partkey*1.3)) END]) AS u FROM part)))))"""
_RAW = """CASE WHEN b <= 0 THEN s WHEN c <= 0 THEN (p(s)^2 - p(s-a)^2 - p(s-b)^2 + p(s-a-b)^2)/(2*a*b)
 ELSE (p(s)^3 - p(s-a)^3 - p(s-b)^3 - p(s-c)^3 + p(s-a-b)^3 + p(s-a-c)^3 + p(s-b-c)^3)/(6*a*b*c) END"""


def _expand(sql: str) -> str:
    import re

    return re.sub(r"\bp\(([^()]*)\)", r"greatest(\1, 0)", sql)


@query(
    f"""WITH t AS (SELECT *, (p_partkey % 13 - 1)/11.0 AS t FROM {_SHAPE}), s AS (SELECT *, least(t, 1-t) AS s FROM t), v AS (SELECT *, {_expand(_RAW)} AS f FROM s)
    SELECT p_partkey, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 1 ELSE greatest(0, least(1, CASE WHEN t <= 0.5 THEN f ELSE 1 - f END)) END, 6) AS below FROM v"""
)
def cell_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of a cube's projection and the share of it below a height."""
    k = F.col("p_partkey")
    up = [F.abs(F.sin(k)) + 0.05, F.when(k % 3 == 0, 0.0).otherwise(F.cos(k * 0.7)), F.when(k % 5 == 0, 0.0).otherwise(F.sin(k * 1.3))]
    df = table(spark, sf_dir, "part").select("p_partkey", P.box_shape(up).alias("w"))
    a, b, c = (F.col("w")[i] for i in range(3))
    return df.select("p_partkey", r(a).alias("a"), r(b).alias("b"), r(c).alias("c"), r(P.cell_cdf((k % 13 - 1) / 11.0, a, b, c)).alias("below"))


@query(
    f"""WITH t AS (SELECT *, 0.05 + (p_partkey % 10)/11.0 AS t FROM {_SHAPE}) SELECT p_partkey, round(t, 5) AS t FROM t"""
)
def cell_cdf_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height whose share was taken comes back."""
    k = F.col("p_partkey")
    up = [F.abs(F.sin(k)) + 0.05, F.when(k % 3 == 0, 0.0).otherwise(F.cos(k * 0.7)), F.when(k % 5 == 0, 0.0).otherwise(F.sin(k * 1.3))]
    df = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", P.box_shape(up).alias("w")).select("p_partkey", *(F.col("w")[i].alias(n) for i, n in enumerate("abc")))
    shape = [F.col(n) for n in "abc"]
    df = df.withColumn("f", P.cell_cdf(F.lit(0.05) + (k % 10) / 11.0, *shape))
    return df.select("p_partkey", r(P.cell_cdf_inverse(F.col("f"), *shape), 5).alias("t"))


@query("SELECT p_partkey, round(sqrt(0.072/9810.0)*least(0.94*power(0.001/0.072*u, 2.0/3), sqrt(0.001/0.072*u)), 9) AS h0 FROM (SELECT p_partkey, greatest(p_retailprice/10000.0, 1e-4) AS u FROM part)")
def lld_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", r(P.withdrawal_film(F.col("p_retailprice") / 10000.0), 9).alias("h0"))


@query(
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity/50.0 AS L, l_discount < 0.03 AS bath, l_discount > 0.07 AS air, l_extendedprice/1e5 AS h, 0.5 AS zb, 0.02 AS e, l_tax > 0.01 AS fl FROM lineitem),
    a AS (SELECT *, 1 - greatest(0, least(1, (zb - h + e)/(2*e))) AS above FROM n)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN bath THEN 0 ELSE L*above END, 12) AS liquid, round(CASE WHEN air THEN 0 ELSE (1-L)*(1-above) END, 12) AS air, round(101325 + 9810*greatest(zb-h, 0), 8) AS p,
    round(101325 + 9810*CASE WHEN bath THEN zb-h ELSE greatest(zb-h, 0) END, 8) AS p_joined, round(CASE WHEN fl THEN greatest(0, least(1, CASE WHEN bath THEN 1 - h/0.7 ELSE L*h/0.7 END)) ELSE 0 END, 12) AS combined FROM a"""
)
def cell_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapped liquid and air, pressure and the new liquid share of cells, from line items."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("L"), (F.col("l_discount") < 0.03).alias("bath"), (F.col("l_discount") > 0.07).alias("open"), (F.col("l_extendedprice") / 1e5).alias("h"), (F.col("l_tax") > 0.01).alias("fl"))
    level, e, h = F.lit(0.5), F.lit(0.02), F.col("h")
    above = P.above_share(h, level, e, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    liquid, air = P.trapped(F.col("L"), F.col("bath"), F.col("open"), above)
    return df.select("l_orderkey", "l_linenumber", r(liquid, 12).alias("liquid"), r(air, 12).alias("air"), r(P.hydrostatic(h, level), 8).alias("p"), r(P.hydrostatic(h, level, F.col("bath")), 8).alias("p_joined"), r(P.combined(F.col("L") * h, h, F.lit(0.7), F.col("bath"), F.col("fl")), 12).alias("combined"))
