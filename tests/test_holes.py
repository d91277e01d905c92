import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.operators import holes
from tarnflow.sources import formats, scenes
from tarnflow.sources.scenes import Raster


def sheet(spark, hole=()):
    """A wall across x = 8 in a raster of 16 x 12 x 12 cells, two cells thick; ``hole``: cells (j, k) that are open."""
    g = Raster((16, 12, 12), 1.0, (0.0, 0.0, 0.0))
    wall = F.col("i").isin(7, 8)
    for j, k in hole:
        wall = wall & ~((F.col("j") == j) & (F.col("k") == k))
    return g, scenes.add(g.cells(spark), wall)


def hole_at(spark, *rows):
    return spark.createDataFrame(rows, "hole_id int, x double, y double, z double, diameter double")


def test_a_hole_takes_its_axis_from_its_sheet_and_is_opened(spark):
    g, cells = sheet(spark)
    listed = hole_at(spark, (1, 8.0, 6.0, 6.0, 3.0), (2, 15.5, 6.0, 6.0, 3.0), (3, 3.0, 3.0, 3.0, 2.0))
    listed = holes.within(listed, (0, 0, 0), (16, 12, 12))
    assert sorted(r.hole_id for r in listed.collect()) == [1, 3]
    axes = holes.hole_axes(cells, listed, 1.0, 3.0)
    found = {r.hole_id: r.normal for r in axes.collect()}
    assert found.keys() == {1} and np.allclose(found[1], (1, 0, 0), atol=1e-9)
    out = holes.carved(cells, listed.join(axes, "hole_id"), 1.0, 3.0)
    opened = {(r.i, r.j, r.k) for r in cells.join(out.filter("not solid").select("node_id"), "node_id", "left_semi").filter("solid").collect()}
    expected = {(i, j, k) for i in (7, 8) for j in range(12) for k in range(12) if math.hypot(j - 5.5, k - 5.5) <= 1.0 and abs(i - 7.5) <= 1}
    assert opened == expected and out.count() == 16 * 12 * 12


def test_too_few_points_have_no_sheet(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 1.0), (2, 0.0, 1.0, 1.0), (2, 3.0, 2.0, 1.0)], "hole_id int, x double, y double, z double")
    got = {r.hole_id: r.normal for r in holes.sheet_normals(pts, "hole_id").collect()}
    assert got[1] is None and np.allclose(got[2], (0, 0, 1))


def test_a_hole_is_the_only_way_or_it_is_not(spark):
    listed = hole_at(spark, (1, 7.5, 6.5, 6.5, 1.0)).withColumn("normal", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    for more, only in (([], True), ([(8, 6)], False)):
        _, cells = sheet(spark, [(6, 6), *more])
        cells = cells.withColumn("solid", F.col("solid") & (F.col("i") == 7))
        (row,) = holes.cuts_that_separate(cells, listed, 1.0, 1.0).collect()
        assert row.separates == only, more


def test_narrow_openings(spark):
    o = spark.createDataFrame([(1, 1, 2, 1.0), (2, 1, 2, 3.9), (3, 2, 3, 1.9)], "opening int, a int, b int, clearance double")
    p = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 2.0)], "region int, peak double")
    assert [r.opening for r in holes.narrow_openings(o, p, 0.7, 10.0).collect()] == [1]
    assert holes.narrow_openings(o, p, 0.7, 0.5).count() == 0


def test_the_largest_disc_in_an_opening(spark):
    rng = np.random.default_rng(2)
    for normal in ((1.0, 0.0, 0.0), (1.0, 2.0, 0.5)):
        n, basis = holes.frame(np.array(normal))
        assert np.allclose(basis @ n, 0) and np.allclose(basis @ basis.T, np.eye(2))
    assert np.allclose(holes.frame(np.array([0.1, -0.99, 0.0]))[0], (0, -1, 0))
    rows = []
    for key, (a, b) in {1: (10, 10), 2: (24, 6), 3: (1, 1)}.items():
        rows += [(key, 5.0 + rng.normal() * 1e-3, 0.5 * j, 0.5 * k, 1.0, 0.0, 0.0, 1.0) for j in range(a) for k in range(b)]
    got = {r.opening: r.width for r in holes.opening_widths(spark.createDataFrame(rows, "opening int, x double, y double, z double, nx double, ny double, nz double, area double"), "opening", 0.5).collect()}
    assert got == {1: pytest.approx(0.5 * (2 * 5 - 0.5)), 2: pytest.approx(0.5 * (2 * 3 - 0.5)), 3: pytest.approx(0.5 * 1.5)}


def test_widths_of_drawn_shapes():
    plane = np.eye(2)
    square = np.array([(i, j) for i in range(7) for j in range(7)], float)
    for at, want in ((square, 7.5), (square[[k for k in range(49) if k not in (16, 17, 23, 24)]], 7.5), (square[:1], 1.5), (square[:7], 1.5)):
        assert holes.disc_width(at * 0.1, plane, 0.1) == pytest.approx(want * 0.1)
    rng = np.random.default_rng(3)
    for _ in range(5):
        at = square[rng.random(49) < 0.95]
        got = holes.disc_width(at, plane, 1.0)
        assert got <= 7.5 and got == holes.disc_width(at[:, ::-1] + 5, plane, 1.0)
    assert holes.disc_width(square[:, :1], np.eye(1), 1.0) == pytest.approx(7.5)
    for normal in ((1, 0, 0), (0, -0.95, 0.1), (0.3, 0.4, 0.5), (0.6, 0.8)):
        n, basis = holes.frame(np.array(normal))
        assert np.allclose(basis @ basis.T, np.eye(len(basis))) and np.allclose(basis @ n, 0)


def test_room_that_entering_liquid_reaches(spark):
    nodes = [(k, 1, float(k % 5), 0.5, 2.0, 0.25) for k in range(10)] + [(99, 2, 0.0, 0.5, 2.0, 0.0)]
    df = spark.createDataFrame(nodes, "node_id long, lab int, h double, e double, v double, liquid double")
    ways = [(k, k + 1) for k in range(9) if k != 4] + [(4, 99)]
    links = spark.createDataFrame(ways + [(b, a) for a, b in ways], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node_id long")
    shape = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    (row,) = holes.room_below(df, links, seeds, 2.0, shape).collect()
    assert row.lab == 1 and row.room == pytest.approx(2 * 0.75 + 2 * 0.75 + 2 * (0.5 - 0.25))
    assert holes.room_below(df, links, seeds, 2.0, shape, 1.0).first().room == 1.0


def test_faces_between_cubes_of_two_sizes(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 1.0, 2.0, 1.0, 1.0, 2.0), (2.0, 1.0, 1.0, 2.0, 0.5, 0.5, 0.5, 1.0)], "ax double, ay double, az double, s double, bx double, by double, bz double, t double")
    centre, normal, area = G.link_face([F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"], F.col("s"), F.col("t"))
    got = df.select(*centre, *normal, area).collect()
    assert tuple(got[0]) == (1.0, 0.5, 0.5, 1.0, 0.0, 0.0, 1.0) and tuple(got[1]) == (1.0, 0.5, 0.5, -1.0, 0.0, 0.0, 1.0)


def test_a_body_is_put_upright(spark):
    rng = np.random.default_rng(5)
    body = [(x, y, z) for x, y, z in rng.uniform((-4, -1.5, 0), (4, 1.5, 1), (3000, 3))] + [(x, y, z) for x, y, z in rng.uniform((-3, -0.8, 1), (0, 0.8, 2), (2500, 3))]
    turn = np.array([[0.0, 0, 1], [1, 0, 0], [0, 1, 0]]) @ np.diag([1.0, -1, -1])
    given = np.array(body) @ turn.T
    rows = np.array(formats.upright(spark.createDataFrame([tuple(map(float, p)) for p in given], "x double, y double, z double")))
    assert np.linalg.det(rows) == pytest.approx(1.0)
    p = given @ rows.T
    assert np.ptp(p[:, 0]) > np.ptp(p[:, 1]) > np.ptp(p[:, 2])
    roof = p[p[:, 2] > np.percentile(p[:, 2], 90)]
    assert np.ptp(roof[:, 1]) < 2 and roof[:, 0].mean() < 0
