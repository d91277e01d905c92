"""Trees over tables against one-by-one algorithms, on many random graphs at once (side by side in one table)."""

import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import forest as T
from tarnflow.operators.order import ranked, running

APART = 1000


def graphs(seed, many, nodes, links, weights=20):
    """Random graphs side by side: graph g has the nodes from g * APART."""
    rng = random.Random(seed)
    out = []
    for g in range(many):
        n = rng.randint(2, nodes)
        for _ in range(rng.randint(1, links)):
            out.append((g * APART + rng.randrange(n), g * APART + rng.randrange(n), rng.randrange(weights)))
    return out


def table(spark, edges):
    return spark.createDataFrame(edges, "u long, v long, w long").repartition(3)


class Union:
    def __init__(self):
        self.of = {}

    def root(self, x):
        while (y := self.of.setdefault(x, x)) != x:
            x = y
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.of[b] = a
        return a != b, a, b


def kruskal(edges):
    least = {}
    for u, v, w in edges:
        if u != v:
            k = (min(u, v), max(u, v))
            least[k] = min(w, least.get(k, w))
    sets, out = Union(), []
    for w, (u, v) in sorted((w, k) for k, w in least.items()):
        grew, a, b = sets.join(u, v)
        if grew:
            out.append((u, v, w, a, b))
    return out, least


@pytest.fixture(scope="module")
def sample():
    return graphs(1, 60, 30, 60) + [(5, 5, 0), (7, 3, 1), (7, 3, 1)] + [(90 * APART, 90 * APART + k, 5) for k in range(1, 300)] + [(91 * APART + k, 91 * APART + k + 1, k % 7) for k in range(400)]


@pytest.fixture(scope="module")
def found(spark, sample):
    extra = spark.createDataFrame([(None, 1, 2), (1, None, 2), (1, 900_000, None)], "u long, v long, w long")
    return T.round_of(T.bottleneck_forest(table(spark, sample).union(extra)))


def test_forest_equals_kruskal(sample, found):
    want, _ = kruskal(sample)
    assert sorted((r.u, r.v, r.w) for r in found.collect()) == sorted(w[:3] for w in want)


def test_heavy_links_inside_light_components_take_no_part_in_rounds(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(g * APART + a, g * APART + b, rng.randrange(400)) for g in range(6) for a in range(50) for b in range(a)]
    edges += [(7 * APART + k, 7 * APART + k + 1, 390 + k % 3) for k in range(40)] + [(7 * APART, 0, 399)]
    want, least = kruskal(edges)
    took, rounds = [], T._rounds
    monkeypatch.setattr(T, "_rounds", lambda e, found: took.append(e.count()) or rounds(e, found))
    assert sorted((r.u, r.v, r.w) for r in T.bottleneck_forest(table(spark, edges)).collect()) == sorted(w[:3] for w in want)
    assert len(took) == 2 and took[0] < 0.6 * len(least) and took[1] < len(least) / 50
    inside = table(spark, edges).withColumn("w", F.struct("w", "v", "u"))
    assert sorted((r.u, r.v) for r in T.bottleneck_forest(inside).collect()) == sorted((r[0], r[1]) for r in struct_forest(least))
    assert len(took) == 4


def struct_forest(least):
    sets, out = Union(), []
    for w, (u, v) in sorted((w, k) for k, w in least.items()):
        if sets.join(u, v)[0]:
            out.append((u, v))
    return out


@pytest.mark.parametrize("block", [T.BLOCK, 64])
def test_merges_equal_one_by_one(sample, found, block):
    want, _ = kruskal(sample)
    rows = sorted(T.merges(found, block).collect(), key=lambda r: r.place)
    assert [(r.w, r.node, r.up) for r in rows] == [(w, b, a) for _, _, w, a, b in want]


def test_components_and_meeting_levels(spark, sample, found):
    want, _ = kruskal(sample)
    tree = T.MergeTree(T.merges(found))
    rng = random.Random(3)
    nodes = sorted({x for e in sample for x in e[:2]})
    asked = [(rng.choice(nodes), rng.randrange(-1, 21)) for _ in range(500)] + [(123456, 5)]
    got = tree.component_at(spark.createDataFrame(asked, "x long, t long"), "x", "t").collect()
    for level in range(-1, 21):
        sets = Union()
        for u, v, w, *_ in want:
            if w <= level:
                sets.join(u, v)
        assert all(r.component == sets.root(r.x) for r in got if r.t == level)
    pairs = [(x, x // APART * APART + rng.randrange(30)) for x in rng.choices(nodes, k=400)] + [(nodes[0], nodes[-1]), (nodes[0], nodes[0])]
    near = {}
    for u, v, w, *_ in want:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))

    def largest(a, b):
        seen, todo = {a: None}, [a]
        while todo:
            x = todo.pop()
            for y, w in near.get(x, []):
                if y not in seen:
                    seen[y] = w if seen[x] is None else max(w, seen[x])
                    todo.append(y)
        return seen.get(b)

    for r in tree.joined_at(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect():
        assert r.level == largest(r.a, r.b), (r.a, r.b)


def test_watershed_cuts_at_the_markers(spark, sample):
    nodes = sorted({x for e in sample for x in e[:2]}) + [777_777]
    marked = {x: x for x in nodes if x % 11 == 0} | {777_777: 1}
    rows = [(x, marked.get(x)) for x in nodes]
    got = {r.node: r.label for r in T.watershed(spark.createDataFrame(rows, "node long, marker long"), table(spark, sample)).collect()}
    _, least = kruskal(sample)
    label = dict(rows)
    while True:  # the lightest link out of what is labelled, one at a time
        out = [(w, u, v) for (u, v), w in least.items() if (label[u] is None) != (label[v] is None)]
        if not out:
            break
        _, u, v = min(out)
        label[u] = label[v] = label[u] if label[u] is not None else label[v]
    assert got == label


def trees(seed):
    rng = random.Random(seed)
    out = []
    for g in range(40):
        n = rng.randint(1, 40)
        out += [(g * APART + k, None if k == 0 else g * APART + rng.randrange(k), rng.randint(-50, 50)) for k in range(n)]
    deep = [(60 * APART + k, None if k == 0 else 60 * APART + k - 1, k) for k in range(700)]
    wide = [(70 * APART + k, None if k == 0 else 70 * APART, 1) for k in range(500)]
    return out + deep + wide


def test_tours_and_subtree_sums(spark):
    rows = trees(4)
    got = {r.node: r for r in T.tour(spark.createDataFrame(rows, "node long, parent long, x long").repartition(3), "x").collect()}
    assert len(got) == len(rows) and sorted(p for r in got.values() for p in (r.enter, r.leave)) == list(range(2 * len(rows)))
    size, total, parent = {n: 1 for n, *_ in rows}, {n: x for n, _, x in rows}, {n: p for n, p, _ in rows}
    for n, p, _ in sorted(rows, reverse=True):
        if p is not None:
            size[p] += size[n]
            total[p] += total[n]
    for n, r in got.items():
        assert (r.size, r.total, r.leave - r.enter) == (size[n], total[n], 2 * size[n] - 1)
        p = parent[n]
        if p is None:
            assert r.depth == 0 and r.root == n
        else:
            assert r.depth == got[p].depth + 1 and got[p].enter < r.enter < r.leave < got[p].leave and r.root == got[p].root


def test_rooted_at_any_node(spark, found):
    edges = {(r.u, r.v) for r in found.collect()}
    for roots in (None, spark.createDataFrame([(90 * APART + 17,), (91 * APART + 200,)], "node long")):
        part = found if roots is None else found.filter(F.col("u") >= 90 * APART)
        got = {r.node: r.parent for r in T.rooted(part, roots).collect()}
        links = {e for e in edges if roots is None or e[0] >= 90 * APART}
        assert {tuple(sorted((n, p))) for n, p in got.items() if p is not None} == links
        for n in got:
            steps = 0
            while got[n] is not None:
                n, steps = got[n], steps + 1
                assert steps <= 500
    assert T.rooted(found.limit(0)).count() == 0 and T.bottleneck_forest(found.limit(0)).count() == 0


def test_range_extremes(spark):
    rng = random.Random(9)
    values = {p: (rng.randrange(1000), rng.randrange(1000)) for p in range(5, 900) if rng.random() < 0.5 and not 300 < p < 420}
    asked = [tuple(sorted((rng.randrange(5, 900), rng.randrange(5, 900)))) for _ in range(400)] + [(p, p) for p in (7, 350)]
    got = T.range_extremes(spark.createDataFrame([(p, *v) for p, v in values.items()], "place long, low long, high long"), spark.createDataFrame(asked, "first long, last long"), span=16)
    for r in got.collect():
        inside = [v for p, v in values.items() if r.first <= p <= r.last]
        assert (r.least, r.most) == ((min(a for a, _ in inside), max(b for _, b in inside)) if inside else (None, None))


def test_blocks_bridges_and_cut_vertices(spark):
    edges = graphs(5, 150, 14, 18) + [(200 * APART + k, 200 * APART + (k + 1) % 300, 0) for k in range(300)] + [(200 * APART + 299, 201 * APART, 0)]
    found = T.round_of(T.blocks(table(spark, edges)))
    links = {(min(u, v), max(u, v)) for u, v, _ in edges if u != v}
    rows = found.collect()
    assert {(r.u, r.v) for r in rows} == links and len(rows) == len(links)

    def pieces(of, without_link=None, without_node=None):
        sets = Union()
        for u, v in of:
            if (u, v) != without_link and without_node not in (u, v):
                sets.join(u, v)
        ends = {x for e in of for x in e} - {without_node}
        return len({sets.root(x) for x in ends})

    by_graph = {}
    for u, v in links:
        by_graph.setdefault(u // APART if u // APART < 200 else 200, []).append((u, v))
    thin, joints = set(), set()
    for g, of in by_graph.items():
        whole = pieces(of)
        if g < 200:
            thin |= {e for e in of if pieces(of, without_link=e) > whole}
            joints |= {x for x in {x for e in of for x in e} if pieces(of, without_node=x) > whole}
    assert {(r.u, r.v) for r in T.bridges(found).collect()} == thin | {(200 * APART + 299, 201 * APART)}
    assert {r.node for r in T.cut_vertices(found).collect()} == joints | {200 * APART + 299}
    # links of a block pairwise share a cycle: taking any one out leaves the others' ends joined
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, []).append((r.u, r.v))
    for of in blocks.values():
        if 1 < len(of) < 100:
            assert pieces(of) == 1 and all(pieces(of, without_node=x) == 1 for x in {x for e in of for x in e})


def test_places_and_running_sums_over_partitions(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("aaaab"), rng.randint(1, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, x long").repartition(7)
    got = ranked(df, [F.col("k").desc()]).collect()
    assert all(r.place == 2999 - r.k for r in got) and len(got) == 3000
    for within in ((), ("g",)):
        sums = {}
        want = {}
        for k, g, x in sorted(rows):
            key = g if within else None
            want[k] = sums[key] = sums.get(key, 0) + x
        assert {r.k: r.upto for r in running(df, ["k"], F.col("x"), "upto", within).collect()} == want
    assert ranked(df.limit(0), ["k"]).count() == 0 and running(df.limit(0), ["k"], F.col("x"), "upto").count() == 0
