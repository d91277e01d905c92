import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import cells, graph, pressure
from tarnflow.sources import scenes
from tarnflow.sources.scenes import Raster


def test_flat_levels_keep_the_volume(spark):
    rows = [(b, 10 * b + k, float(k), 0.5, 1.0 + k % 2, [0.9, 0.2, 0.5, 0.0][k]) for b in (1, 2) for k in range(4)]
    df = spark.createDataFrame(rows, "body int, node_id long, h double, e double, v double, share double")
    out = cells.flat_levels(df).join(df, ["body", "node_id"]).collect()
    for b in (1, 2):
        own = sorted((r for r in out if r.body == b), key=lambda r: r.h)
        assert sum(r.flat * r.v for r in own) == pytest.approx(sum(r.share * r.v for r in own), abs=1e-9)
        assert [r.flat for r in own] == sorted((r.flat for r in own), reverse=True) and sum(0 < r.flat < 1 for r in own) <= 1


def test_only_passages_that_connect_stay(spark):
    links = [(1, 2), (2, 3), (3, 50), (1, 40), (10, 11), (11, 40)]
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "src long, dst long")
    narrow = spark.createDataFrame([(k,) for k in (1, 2, 3, 10, 11)], "node_id long")
    outside = spark.createDataFrame([(40, 1), (50, 2)], "node_id long, region int")
    assert [r.passage for r in cells.connecting(narrow, both, outside).collect()] == [1]


def test_widest_clearance_is_the_bottleneck(spark):
    nodes = spark.createDataFrame([(1, 5.0), (2, 2.0), (3, 1.0), (4, 4.0), (5, 3.0)], "node_id long, distance double")
    links = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4), (4, 5)], "src long, dst long")
    side = lambda *k: spark.createDataFrame([(x,) for x in k], "node_id long")
    assert cells.widest_clearance(nodes, links, side(1), side(5)) == pytest.approx(4.0)
    assert cells.widest_clearance(nodes, links, side(1), side(9)) is None


def test_a_closed_mesh_is_filled(spark):
    g = Raster((9, 9, 9), 1.0, (0.0, 0.0, 0.0))
    c = g.cells(spark)
    shell = (F.greatest(F.abs(F.col("i") - 4), F.abs(F.col("j") - 4), F.abs(F.col("k") - 4)) == 2)
    links = scenes.face_links(g, c)
    out = cells.voxelised(c.select("node_id", "boundary"), c.filter(shell), links)
    assert out.filter("solid").count() == 125
    faces = cells.links_by(c.select("node_id", "i", "j", "k"), [s for s in cells.ALL_STEPS if sum(map(abs, s)) == 1])
    assert faces.count() == links.count() and graph.once(faces).count() * 2 == faces.count()


def test_heads_balance(spark):
    vessels = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, None), (1, 3, 0.0), (2, 5, None)], "cluster long, vessel long, head double")
    ways = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 2.0), (1, 2, 3, 1.0)], "cluster long, a long, b long, k double")
    got = {r.vessel: r.head for r in pressure.balanced_heads(vessels, ways).collect()}
    q = [k * math.sqrt(got[a] - got[b]) for a, b, k in ((0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0))]
    assert max(q) - min(q) < 1e-5 and 2 > got[1] > got[2] > 0 and (got[5] is None or math.isnan(got[5]))


def test_channels_store_and_pass(spark):
    c = spark.createDataFrame([(k, h + 0.5, 0.5, 1e-3, 0.0) for k in (1, 2) for h in range(4)], "channel long, h double, e double, v double, liquid double")
    m = spark.createDataFrame([(1, 0, 1.0, 1e-4, 3.0, True), (1, 1, 0.0, 1e-4, None, True), (2, 0, 1.0, 1e-4, 3.0, False), (2, 1, 0.0, 1e-4, None, False)], "channel long, mouth long, h double, area double, outside double, vented boolean")
    got = {(r.channel, r.mouth): r for r in pressure.channel_levels(c, m, 0.5).collect()}
    stored = -0.5 * (got[1, 0].flow + got[1, 1].flow)
    level = got[1, 0].level
    assert stored == pytest.approx(float(np.sum(1e-3 * np.clip(level - np.arange(4), 0, 1))), abs=1e-9) and stored > 0
    assert got[2, 0].flow + got[2, 1].flow == pytest.approx(0, abs=1e-8) and got[2, 0].flow < 0
