import numpy as np

import plain_fsm
from tarnflow.operators import fsm
from tarnflow.plans import flow


def raster(seed, shape=(9, 8, 10)):
    rng = np.random.default_rng(seed)
    solid = rng.random(shape) < 0.3
    up = rng.normal(size=3)
    index = np.indices(shape)
    h = np.round(sum(u * x for u, x in zip(up / np.linalg.norm(up), index, strict=True)), 9).ravel()
    ids = np.arange(h.size).reshape(shape)
    links = [[] for _ in range(h.size)]
    for axis in range(3):
        a, b = np.moveaxis(ids, axis, 0)[:-1].ravel(), np.moveaxis(ids, axis, 0)[1:].ravel()
        for x, y in zip(a, b, strict=True):
            if not solid.ravel()[x] and not solid.ravel()[y]:
                links[x].append(int(y))
                links[y].append(int(x))
    edge = np.zeros(shape, bool)
    for axis in range(3):
        np.moveaxis(edge, axis, 0)[[0, -1]] = True
    region = np.where(solid.ravel(), -1, 0)
    return h, region, links, edge.ravel() & (region >= 0), rng


def test_the_kernel_of_arrays_equals_plain_loops():
    for seed in range(30):
        h, region, links, sink, rng = raster(seed, ((6, 5, 7), (12, 3, 4), (9, 8, 10))[seed % 3])
        if seed % 4 == 1:
            h = np.round(h)  # many ties
        if seed % 4 == 2:
            region = np.where(region >= 0, (np.arange(h.size) % 97 > 40).astype(int), -1)
        if seed % 5 == 3:
            sink = sink & (rng.random(h.size) < 0.03)
        src = np.where((region >= 0) & ~sink, rng.random(h.size) * (1 + 4 * (rng.random(h.size) < 0.1)), 0.0)
        v = rng.random(h.size) + 0.5
        for e, depth, shape, routing in ((0.0, 0.0, (1.0, 0.0, 0.0), True), (0.3, 0.0, (0.5, 0.3, 0.2), True), (0.4, 0.5, (0.6, 0.4, 0.0), True), (0.3, 0.0, (1.0, 0.0, 0.0), False)):
            ext = np.full(h.size, e)
            got = fsm.settle(h, region, links, sink, src, v, ext, shape, depth, routing)
            want = plain_fsm.settle(h, region, links, sink, src, v, ext, shape, depth, routing)
            assert np.allclose(got[0], want[0], atol=1e-9), (seed, e)
            assert all(abs(got[k][r] - want[k][r]) < 1e-9 for k in (1, 2) for r in want[k])
            assert (got[3] == want[3]).all()


def test_scenes_share_a_call_without_touching(spark):
    rows, ways = [], []
    want = {}
    for seed in range(5):
        h, region, links, sink, rng = raster(seed, (5, 4, 6))
        src = np.where((region >= 0) & ~sink, rng.random(h.size), 0.0)
        kept, drained, lost, dest = plain_fsm.settle(h, region, links, sink, src, np.ones(h.size))
        for i in np.flatnonzero(region >= 0).tolist():
            rows.append((seed, 1000 - i, float(h[i]), 0, bool(sink[i]), float(src[i]), 1.0, 0.0))
            ways += [(seed, 1000 - i, 1000 - m) for m in links[i]]
        want[seed] = kept.sum(), sum(drained.values()), sum(lost.values())
    ways.append((0, 1, 2))  # no such nodes
    nodes = spark.createDataFrame(rows, "scenario_id long, node_id long, h double, region int, sink boolean, src double, v double, e double")
    got = fsm.fill_spill(nodes, spark.createDataFrame(ways, "scenario_id long, src long, dst long")).groupBy("scenario_id").agg({"retained": "sum", "drained": "sum", "lost": "sum", "node_id": "count", "owner": "min"}).collect()
    assert len(got) == 5 and sum(r["count(node_id)"] for r in got) == len(rows)
    for r in got:
        assert np.allclose((r["sum(drained)"] + r["sum(retained)"] + r["sum(lost)"]), sum(want[r.scenario_id])) and r["min(owner)"] == 0


def test_random_fields_conserve_and_settle_once():
    for seed in range(6):
        h, region, links, sink, rng = raster(seed)
        src = np.where((region >= 0) & ~sink, rng.random(h.size), 0.0)
        for e, depth in ((0.0, 0.0), (0.3, 0.0), (0.3, 0.4)):
            extent = np.full(h.size, e)
            v = np.ones(h.size)
            kept, drained, lost, _ = fsm.settle(h, region, links, sink, src, v, extent, (0.5, 0.3, 0.2), depth)
            assert abs(kept.sum() + sum(drained.values()) + sum(lost.values()) - src.sum()) < 1e-9
            assert (kept >= -1e-12).all() and (kept <= v + 1e-9).all()
            again, drained, _, _ = fsm.settle(h, region, links, sink, kept, v, extent, (0.5, 0.3, 0.2), depth)
            if not e:
                assert np.allclose(again, kept, atol=1e-9) and sum(drained.values()) < 1e-9


def test_flooding_equals_minimax_heights():
    for seed in range(4):
        h, region, links, sink, _ = raster(seed)
        src = np.where(region >= 0, 1.0, 0.0)
        kept, _, _, _ = fsm.settle(h, region, links, sink, src, np.ones(h.size))
        level = np.where(sink, -np.inf, np.inf)
        while True:
            new = level.copy()
            for i in np.flatnonzero((region >= 0) & ~sink):
                if links[i]:
                    new[i] = min(new[i], max(h[i], min(level[m] for m in links[i])))
            if (new == level).all():
                break
            level = new
        held = (region >= 0) & ~sink & (h < level)
        assert np.allclose(kept[region >= 0], held[region >= 0], atol=1e-9)


def test_kernel_and_tables_flood_alike(spark):
    tables = {r.node_id: r.held for r in fsm.flooded(*flow.field(spark, "/root/testdata/sf0.001")).collect()}
    kernel = {r.node_id: r.retained for r in flow.fill_spill_random(spark, "/root/testdata/sf0.001").collect()}
    assert tables.keys() == kernel.keys() and all(abs(kernel[k] - held) < 1e-9 for k, held in tables.items())


def test_scenes_whose_volumes_follow_from_counting_cells(spark):
    """name: kept, gone, in the first vessel, in what it spills into."""
    want = {
        "bottle_full": (128, 384, 128, 0), "bottle_third": (128, 64, 128, 0), "plate": (0, 64, 0, 0), "tray": (64, 0, 64, 0), "cascade": (1040, 280, 600, 440), "deep_cup": (1320, 0, 600, 720),
        "two_stage": (1192, 128, 600, 592), "merged_lake": (512, 0, 216, 216), "saddle_40": (256, 0, 216, 40), "saddle_60": (276, 0, 216, 60), "saddle_150": (366, 0, 216, 96),
    }
    got = {r["name"]: (r.kept, r.gone, r["first"], r["second"]) for r in flow.fill_spill_scenes(spark, "").collect()}
    assert got == want
    off = flow.cup_spill_routing_off(spark, "").collect()
    assert [(r["name"], r.kept, r.gone) for r in off] == [("cascade", 600.0, 720.0)]
