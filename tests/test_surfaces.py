import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import film, merging, segment, surface
from tarnflow.sources import scenes
from tarnflow.sources.formats import FACES, indexed
from tarnflow.sources.scenes import Raster


def mesh(spark, triangles):
    rows = [("m", k, *map(float, np.asarray(t).ravel())) for k, t in enumerate(triangles)]
    return surface.with_geometry(spark.createDataFrame(rows, FACES))


def quad(a, b, c, d):
    return [[a, b, c], [a, c, d]]


def tube(radius, depth, n, inward):
    out = []
    for k in range(n):
        p, q = (2 * math.pi * (x % n) / n for x in (k, k + 1))
        a, b = (radius * math.cos(p), radius * math.sin(p)), (radius * math.cos(q), radius * math.sin(q))
        f = quad((*a, 0), (*b, 0), (*b, depth), (*a, depth))
        out += [t[::-1] for t in f] if inward else f
    return out


def test_rings_are_holes_and_pins(spark):
    plate = quad((-1, -1, 0), (1, -1, 0), (1, 1, 0), (-1, 1, 0))
    far = [[(x + 5, y, z) for x, y, z in t] for t in tube(0.004, 0.003, 16, False)]
    faces = mesh(spark, [*tube(0.01, 0.001, 24, True), *far, *plate])
    _, by_vertex = indexed(faces)
    patches = surface.smooth_patches(faces, surface.face_pairs(by_vertex))
    rings = {r.kind: r for r in surface.ring_patches(faces, patches, 0.005, 0.05).collect()}
    assert rings.keys() == {1, -1}
    assert rings[1].diameter == pytest.approx(0.02, rel=0.03) and abs(rings[1].az) == pytest.approx(1, abs=1e-6)
    assert rings[-1].diameter == pytest.approx(0.008, rel=0.05) and rings[-1].x == pytest.approx(5, abs=1e-6)
    assert surface.free_edges(by_vertex).count() == 2 * 24 + 2 * 16 + 4


def test_gap_between_two_plates(spark):
    below = quad((0, 0, 0), (0.1, 0, 0), (0.1, 0.1, 0), (0, 0.1, 0))
    above = [t[::-1] for t in quad((0, 0, 0.0008), (0.1, 0, 0.0008), (0.1, 0.1, 0.0008), (0, 0.1, 0.0008))]
    faces = mesh(spark, [*below, *above])
    samples = surface.gap_samples(faces, 0.01, 0.005)
    assert samples.agg(F.sum("area")).first()[0] == pytest.approx(0.02)
    assert {round(r.width, 9) for r in samples.collect()} == {0.0008} and samples.filter("not facing").count() == 0
    regions = surface.gap_regions(samples, 0.0, 0.002, 0.01).collect()
    assert sum(r.area for r in regions) == pytest.approx(0.02) and all(r.median == pytest.approx(0.0008) for r in regions)
    assert regions[0].area == pytest.approx(0.01, rel=0.2)
    nodes = surface.channel_nodes(samples.withColumn("channel", F.lit(1)), 0.02).collect()
    assert sum(n.volume for n in nodes) == pytest.approx(0.01 * 0.0008)


def test_cells_of_faces_equal_sampling(spark):
    rng = np.random.default_rng(3)
    tris = rng.random((6, 3, 3)) * 0.9 + 0.05
    got = {(r.face_id, r.i, r.j, r.k) for r in surface.cells_of_faces(mesh(spark, tris), 0.125, (0, 0, 0), (8, 8, 8)).collect()}
    u = rng.random((40000, 2))
    u = np.where(u.sum(axis=1, keepdims=True) > 1, 1 - u, u)
    for k, t in enumerate(tris):
        p = t[0] + u[:, :1] * (t[1] - t[0]) + u[:, 1:] * (t[2] - t[0])
        assert {(k, *map(int, c)) for c in np.unique(np.floor(p / 0.125), axis=0)} <= got
    assert len(got) < 6 * 8**3 / 4


def test_two_rooms_and_the_door_between(spark):
    g = Raster((22, 12, 12), 0.01, (0.0, 0.0, 0.0))
    cells = g.cells(spark)
    inside = F.col("i").between(1, 20) & F.col("j").between(1, 10) & F.col("k").between(1, 10)
    wall = F.col("i").between(10, 11) & ~(F.col("j").between(5, 6) & F.col("k").between(5, 6))
    cells = scenes.add(cells, ~inside | wall)
    fluid, links = cells.filter("not solid"), scenes.face_links(g, cells)
    d = segment.wall_distance(fluid, cells.filter("solid"), g.dx, 0.08)
    marks = segment.maxima(d, links)
    nodes = fluid.join(d, "node_id").join(marks, "node_id", "left").select(F.lit(0).cast("long").alias("scenario_id"), "node_id", "distance", F.col("marker").alias("label"))
    labels = segment.watershed(nodes, links.withColumn("scenario_id", F.lit(0).cast("long")).select("scenario_id", "src", "dst"))
    full = fluid.join(labels, "node_id").join(d, "node_id")
    assert full.filter("label < 0").count() == 0
    regions = full.groupBy("label").agg(F.max("distance").alias("peak"), F.count(F.lit(1)).cast("double").alias("size"))
    into = merging.merged(regions, segment.region_pairs(full, links), beta=0.7, r_free=0.5, least=10)
    full = full.join(into, "label").withColumn("label", F.col("into"))
    sizes = sorted(r["count"] for r in full.groupBy("label").count().collect())
    assert len(sizes) == 2 and sizes[0] >= 900
    throats = segment.throats(full, links, g.dx).collect()
    assert len(throats) == 1 and throats[0].faces == 4 and throats[0].area == pytest.approx(4e-4)
    zero = segment.exterior_zero(full.withColumn("boundary", F.col("i") == 1)).groupBy("label").count().collect()
    assert sorted(r.label for r in zero) == [0, 1]


def test_a_film_runs_down_and_is_kept(spark):
    n = 12
    elements = spark.createDataFrame([(1, k, float(n - k), 1e-4 if k < 6 else 0.0, 1e-4, k == n - 1) for k in range(n)], "film_id long, elem long, height double, h double, area double, sub boolean")
    edges = spark.createDataFrame([(k, k + 1, 0.01, 1.0, -1.0) for k in range(n - 1)], "ei long, ej long, length double, mi double, mj double")
    weights = film.directed(elements, edges)
    assert sorted(map(tuple, film.levels(weights).collect())) == [(k, k) for k in range(n)]
    assert film.outflow_rates(weights).count() == n - 1
    out = film.swept(elements, weights.withColumn("film_id", F.lit(1).cast("long")), 2.0).collect()
    kept = sum(r.h * 1e-4 + r.absorbed for r in out)
    assert kept == pytest.approx(6 * 1e-8, rel=1e-9) and all(r.h >= 0 for r in out)
    by = {r.elem: r.h for r in out}
    assert by[0] < by[3] < 1e-4 and by[8] > 0
    hanging = spark.createDataFrame([(1, 1, 4e-4, 1e-4, 7, 0.5), (1, 2, 3e-4, 1e-4, 8, 0.4), (2, 3, 1e-4, 1e-4, 9, 0.1)], "group int, elem long, h double, area double, cell long, height double")
    fallen = film.drops(hanging)
    assert [tuple(r) for r in fallen.select("group", "drops", "cell").collect()] == [(1, 1, 8)]
    taken = {r.elem: r.taken for r in film.after_drops(hanging, fallen).collect()}
    assert taken[1] == pytest.approx(4e-8) and taken[2] == pytest.approx(1e-8) and taken[3] == 0


def test_sight_lines_and_smoothing(spark):
    wall = spark.createDataFrame([(0, "m", 0, 0.5, -9.0, -9.0, 0.5, 9.0, -9.0, 0.5, 0.0, 9.0)], "cell int, " + FACES)
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0), (2, 0.0, 0.0, 0.0, 0)], "point int, x double, y double, z double, cell int")
    targets = spark.createDataFrame([(1, 10, 1.0, 0.0, 0.0), (1, 11, -2.0, 0.0, 0.0), (2, 10, 1.0, 0.0, 0.0)], "point int, target int, x double, y double, z double")
    assert [tuple(r) for r in surface.crossings(points, targets, wall).collect()] == [(1, 11, 0)]
    ring = spark.createDataFrame([(k, math.cos(k * math.pi / 8) * (1.1 if k % 2 else 0.9), math.sin(k * math.pi / 8), 0.0) for k in range(16)], "id int, x double, y double, z double")
    pairs = spark.createDataFrame([(k, (k + 1) % 16) for k in range(16)], "src int, dst int")
    rough = lambda df: df.agg(F.stddev(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).first()[0]
    assert rough(surface.smoothed(ring, pairs)) < 0.5 * rough(ring)
    line = spark.createDataFrame([(1, float(k), 2.0 * k, 0.0) for k in range(5)], "g int, x double, y double, z double")
    assert surface.strips(line, ["g"]).first().length == pytest.approx(4 * math.sqrt(5))
