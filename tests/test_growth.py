"""Plans of queries that failed on large tables: what made them fail isn't in them."""

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarnflow import catalog
from tarnflow.functions import physics
from tarnflow.operators import cells, fsm, graph, keys
from tarnflow.plans import more
from tarnflow.sources import scenes
from tarnflow.streaming import simulation

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def filters(df) -> list[str]:
    return [line for line in plan(df).splitlines() if "Filter" in line]


def test_a_capsule_is_counted_without_a_filter_over_its_arithmetic(spark):
    df = catalog.QUERIES["shape_capsule"](spark, SMALL)
    assert "SQRT" in plan(df) and not any("SQRT" in line for line in filters(df))


def test_a_polyline_is_counted_without_a_filter_over_its_arithmetic(spark):
    df = catalog.QUERIES["shape_polyline"](spark, SMALL)
    assert "SQRT" in plan(df) and not any("SQRT" in line for line in filters(df))


def test_neighbours_in_a_raster_join_no_cells(spark):
    text = plan(catalog.QUERIES["face_neighbors"](spark, SMALL))
    assert "HashJoin" not in text and "SortMergeJoin" not in text  # only the raster's own pairs are sent along


def test_parts_are_dealt_before_they_become_rasters(spark):
    text = plan(catalog.QUERIES["raster_centers"](spark, SMALL))
    assert text.index("Generate") < text.index("Exchange")  # the plan's root stands first


def boxes(spark):
    rows = [(k, k // 72, k // 8 % 9, k % 8, k // 72 + 0.5, k // 8 % 9 + 0.5, k % 8 + 0.5, False) for k in range(720)]
    return spark.createDataFrame(rows, "node_id long, i long, j int, k int, x double, y double, z double, solid boolean")


def test_more_holes_than_were_allowed_find_the_links_of_one_by_one(spark):
    from itertools import product
    from math import hypot

    rows = [(n, n % 11 - 0.2, n % 10 * 0.97, n % 9 * 1.03, *((1.0, 0.0, 0.0), (0.0, 0.6, 0.8))[n % 2], 0.01 + n % 5) for n in range(12000)]
    holes = spark.createDataFrame(rows, "hole_id long, x double, y double, z double, ax double, ay double, az double, diameter double")
    b = boxes(spark)
    got = {tuple(r) for r in cells.crossing_plane(scenes.face_links(more.BOX, b).filter("src < dst"), b, holes, 0.5).filter("hole_id < 40").collect()}
    at = {k: (k // 72 + 0.5, k // 8 % 9 + 0.5, k % 8 + 0.5) for k in range(720)}
    links = [(k, k + s) for k, s in product(at, (1, 8, 72)) if k + s in at and sum(abs(p - q) for p, q in zip(at[k], at[k + s])) == 1]
    want = set()
    for (n, x, y, z, *axis, d), (a, c) in product(rows[:40], links):
        on = [sum((p - q) * v for p, q, v in zip(at[e], (x, y, z), axis)) for e in (a, c)]
        mid = [(p + q) / 2 - o for p, q, o in zip(at[a], at[c], (x, y, z))]
        along = sum(m * v for m, v in zip(mid, axis))
        if on[0] * on[1] <= 0 and on[0] != on[1] and hypot(*(m - along * v for m, v in zip(mid, axis))) <= d / 2 + 0.5:
            want.add((n, a, c))
    assert got == want and len(want) > 100


def test_links_by_edges_and_corners_go_by_shuffle_and_are_found_once(spark):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES["links26"](spark, SMALL))
    b = boxes(spark).select("node_id", "i", "j", "k")
    all_ = {tuple(sorted(r)) for r in cells.links_by(b, cells.CORNER_STEPS).collect()}
    got = [tuple(r) for r in cells.links_by(b, cells.CORNER_STEPS, half=True).collect()]
    assert len(got) == len(set(got)) and set(got) == all_


def test_links_of_subcells_go_by_shuffle(spark):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES["subcell_links"](spark, SMALL))


def test_subcells_of_large_order_numbers_are_summed(spark, tmp_path):
    first = 72 * 10_000_000
    rows = [(first + k, 0 if k else 99) for k in range(72)]  # all closed but the first
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    (row,) = catalog.QUERIES["cut_subcells"](spark, str(tmp_path)).collect()
    i = 20_000_000
    want = sum((i + a) * 10000 + (2 * y + b) * 100 + 2 * z + c for y, z in ((1, 0), (0, 1)) for a in (0, 1) for b in (0, 1) for c in (0, 1))
    assert (row.subcells, row.hosts, row.ids) == (16, 2, want)


def test_heights_of_shares_come_from_whole_batches_and_null_stays_null(spark):
    rows = [(0.05 + k / 70, *((1.0, 0.0, 0.0), (0.7, 0.3, 0.0), (0.5, 0.3, 0.2))[k % 3]) for k in range(60)]
    df = spark.createDataFrame([*rows, (None, 0.5, 0.3, 0.2)], "t double, a double, b double, c double")
    shape = [F.col(c) for c in "abc"]
    share = F.when(F.col("t").isNotNull(), physics.cell_cdf(F.col("t"), *shape))
    out = df.select("t", physics.cell_cdf_inverse(share, *shape).alias("back")).collect()
    assert all(r.back is None if r.t is None else abs(r.back - r.t) < 1e-7 for r in out) and len(out) == 61
    assert "ArrowEvalPython" in plan(catalog.QUERIES["cell_cdf_inverse"](spark, SMALL))


def test_scenarios_that_differ_in_their_number_share_a_run(spark):
    rows = [(k, "closed_box", {"fill": (3 + k % 2) / 14}, 2, 0.5, 50.0) for k in range(7)]
    kind = "scenario_id long, scene string, parameters map<string,double>, steps int, dt double, turn double"
    both = simulation.run(spark.createDataFrame(rows, kind), state=True).collect()
    alone = [r for k in (0, 1) for r in simulation.run(spark.createDataFrame(rows[k : k + 1], kind), state=True).collect()]
    want = {(r.scenario_id, r.step): r[2:] for r in alone}
    assert len(both) == 14 and all(r[2:] == want[r.scenario_id % 2, r.step] for r in both)
    one = [simulation._content(Row(scenario_id=k, scene="tank", parameters={"b": 1.0, "a": x}, steps=3, dt=0.1, turn=0.0)) for k, x in ((1, 0.0), (2, 0.0), (3, 1.0))]
    assert one[0] == one[1] != one[2]


def test_equal_scenes_are_settled_once_and_keep_the_same(monkeypatch):
    def table(rows):
        names = ("scenario_id", "link", "a", "b", "to", "sink", "h", "region", "src", "v", "e")
        return pa.table({n: [r[q] for r in rows] for q, n in enumerate(names)})

    def cup(s, poured):  # a sink, a rim, two cells of a hollow
        heights, to = (0.0, 3.0, 1.0, 2.0), ([1], [0, 2], [1, 3], [2])
        return [(s, False, c, 0, to[c], c == 0, heights[c], 0, poured if c == 2 else 0.0, 1.0, 0.0) for c in range(4)]

    t = table([row for s, poured in ((3, 1.0), (5, 5.0), (8, 1.0), (9, 5.0), (12, 1.0)) for row in cup(s, poured)])
    settled, asked = fsm._scenes, []
    want = settled(t, 0.0, True, (1.0, 0.0, 0.0))
    monkeypatch.setattr(fsm, "_scenes", lambda rows, *more: asked.append(rows.num_rows) or settled(rows, *more))
    assert fsm._settled(t, 0.0, True, (1.0, 0.0, 0.0)).equals(want) and asked == [8]


def test_a_field_is_not_sent_along(spark):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES["steepest_neighbor"](spark, SMALL))


def test_points_of_a_cell_are_looked_for_once_and_all_answered(spark):
    dims, closed = (8, 4, 4), spark.createDataFrame([(0,), (77,)], "key long")
    leaves = keys.graded(closed, dims, 2)
    rows = [(k % 9 - 0.5, k % 5 * 0.9, k % 7 * 0.7) for k in range(200)] + [(None, 1.0, 1.0), (0.5, 0.5, 0.5)]
    points = spark.createDataFrame(rows, "x double, y double, z double")
    got = keys.located(points, leaves, dims, 2, 1.0, (0, 0, 0))
    held = {(r.level, r.key) for r in leaves.collect()}

    def leaf(x, y, z):
        at = [-1 if v is None else int(v // 1) for v in (x, y, z)]
        if any(not 0 <= c < n for c, n in zip(at, dims)):
            return (None, None)
        names = [(lv, ((at[0] >> lv) * (4 >> lv) + (at[1] >> lv)) * (4 >> lv) + (at[2] >> lv)) for lv in range(3)]
        return next((n for n in names if n in held), (None, None))

    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(((*r, *leaf(*r)) for r in rows), key=order)


def test_pairs_of_subcells_and_labels_are_dealt_once_and_not_joined_with_themselves(spark):
    text = plan(catalog.QUERIES["shared_volume"](spark, SMALL))
    assert text.count("FileScan") == 2 and "REPARTITION_BY_NUM" in text and "Window" in text


def test_only_levels_that_rose_feed_on(spark, monkeypatch):
    full = spark.createDataFrame([(k,) for k in range(1, 40)], "lab long")
    throats = spark.createDataFrame([(k, k + 1, 5.0 if k == 0 else None, None, 1.0) for k in range(9)] + [(0, k, 4.0, None, 1.0) for k in range(10, 40)], "a long, b long, level_a double, level_b double, top double")
    rose, round_of = [], graph.round_of

    def seen(df):
        out = round_of(df)
        if "was" in out.columns:
            rose.append(out.filter("was is null or level > was").count())
        return out

    monkeypatch.setattr(graph, "round_of", seen)
    assert sorted(map(tuple, graph.fed_levels(full, throats).collect())) == [(k, 5.0) for k in range(1, 10)] + [(k, 4.0) for k in range(10, 40)]
    assert rose == [31, *[1] * 8, 0]


def test_suction_goes_from_body_to_body_and_near_numbers_hang_on_one_of_their_batch(spark, monkeypatch):
    import random

    from tarnflow.operators import components

    rng = random.Random(5)
    n = {k: (rng.choice((True, True, False, False, None)), rng.random() < 0.03) for k in range(1200)}
    nodes = spark.createDataFrame([(k, *v) for k, v in n.items()], "node_id long, below boolean, boundary boolean")
    links = [(k, k + s) for k in n for s in (1, 40) if k + s in n and rng.random() < 0.7]
    edges = spark.createDataFrame(links, "src long, dst long")

    def reached(seeds, pairs):
        pairs, found = list(pairs), set(seeds)
        while more := {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in found} - found:
            found |= more
        return found

    same = [(a, b) for a, b in links if n[a][0] is not None and n[a][0] == n[b][0]]
    open_ = reached((k for k in n if n[k][1]), same)
    air = {k for k in open_ if n[k][0] is not True}  # of null, nothing is known
    wet = reached(open_ - air, [(a, b) for a, b in links if a not in air and b not in air])
    asked, inner, least = [], [], components._least
    monkeypatch.setattr(graph, "connected_components", lambda e, **more: asked.append(e.count()) or components.connected_components(e, **more))
    monkeypatch.setattr(components, "_least", lambda e: inner.append(e.count()) or least(e))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        got = graph.bath_and_atmosphere(nodes, edges, suction=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(n) and {r.node_id for r in got if r.bath} == wet and len(wet - open_) > 10
    assert {r.node_id for r in got if r.atmosphere} == {k for k in air if n[k][0] is False}
    assert asked[0] == len(same) and asked[1] < len(links) - len(same)  # the second time only what crosses
    assert inner[0] < len(n) + 200 and inner[1] * 4 < asked[0]  # stars, then what is between batches


def test_pairs_are_joined_a_few_times_however_deep_their_tree_is(spark, monkeypatch):
    from tarnflow.operators import forest

    links = [(k, k + 1, float(100 - k)) for k in range(100)] + [(200, 201, 3.0)]  # 100 goes up in 99 first, and so on
    tree = forest.MergeTree(forest.merges(spark.createDataFrame(links, "u long, v long, w double"), 16))
    assert len(tree.steps) == 7
    rows = [(n, n * 7 % 101, n * 31 % 101) for n in range(300)] + [(300, 5, 200), (301, 201, 200), (302, 5, 5), (303, None, 5), (304, 999, 5)]
    rounds, round_of = [], forest.round_of
    monkeypatch.setattr(forest, "round_of", lambda df: rounds.append("pair" in df.columns) or round_of(df))
    got = {r[0]: r[3] for r in tree.joined_at(spark.createDataFrame(rows, "pair long, a long, b long"), "a", "b").collect()}
    want = {n: float(100 - min(a, b)) if a != b else None for n, a, b in rows[:300]} | {300: None, 301: 3.0, 302: None, 303: None, 304: None}
    assert got == want and sum(rounds) == 1


def test_links_of_a_range_are_thinned_before_the_rounds(spark, monkeypatch):
    import random

    from tarnflow.operators import forest

    rng = random.Random(11)
    links = [(1000 * g + a, 1000 * g + b, rng.randrange(300)) for g in range(4) for a in range(60) for b in range(60)]
    df = spark.createDataFrame(links, "u long, v long, w long").repartition(5)
    weights = {"w": F.col("w"), "inside": F.struct("w", "u")}
    plain = {n: sorted(map(tuple, forest.bottleneck_forest(df.withColumn("x", w), "x").collect())) for n, w in weights.items()}
    took, rounds = [], forest._rounds
    monkeypatch.setattr(forest, "_rounds", lambda e, found: took.append(e.count()) or rounds(e, found))
    monkeypatch.setattr(forest, "FEW_LINKS", 100)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 150)
    try:
        for most, n in ((500, "inside"), (500, "w"), (100, "w")):  # the last with forests given out that are too large to hold
            monkeypatch.setattr(forest, "THINNED", most)
            took.clear()
            assert sorted(map(tuple, forest.bottleneck_forest(df.withColumn("x", weights[n]), "x").collect())) == plain[n]
            assert most == 100 or sum(took) < 4 * 60 * 2  # of 7080
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_those_who_ask_for_components_pass_once_for_two_lengths_of_steps(spark, monkeypatch):
    from tarnflow.operators import forest

    for n, steps in ((100, 7), (50, 6)):
        links = [(k, k + 1, float(n - k)) for k in range(n)] + [(200, 201, 3.0)]  # node n goes up in n - 1 first, and so on
        tree = forest.MergeTree(forest.merges(spark.createDataFrame(links, "u long, v long, w double"), 16))
        assert len(tree.steps) == steps
        rows = [(x, x % (n + 1), float(x * 31 % (n + 3))) for x in range(300)] + [(300, 201, 2.5), (301, 201, 3.0), (302, 5, None), (303, None, 5.0), (304, 999, 5.0)]
        rounds, round_of = [], forest.round_of
        with monkeypatch.context() as m:
            m.setattr(forest, "round_of", lambda df: rounds.append("asked" in df.columns) or round_of(df))
            got = {r[0]: r[3] for r in tree.component_at(spark.createDataFrame(rows, "asked long, node long, level double"), "node", "level").collect()}
        want = {i: min(x, max(0, n - int(t))) for i, x, t in rows[:300]} | {300: 201, 301: 200, 302: 5, 303: None, 304: 999}
        assert got == want and sum(rounds) == (steps + 1) // 2
