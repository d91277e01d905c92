"""Fill-spill-merge on scenes: closed forms, hand-derived counts and the staged operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import fsm
from tarnflow.operators.session import never_sent, spread
from tarnflow.plans.registry import query, r, table
from tarnflow.sources import scenes
from tarnflow.sources.scenes import Raster


def block(i: tuple[int, int], j: tuple[int, int], k: tuple[int, int]) -> Column:
    """Cells with indices in half-open ranges."""
    return (F.col("i") >= i[0]) & (F.col("i") < i[1]) & (F.col("j") >= j[0]) & (F.col("j") < j[1]) & (F.col("k") >= k[0]) & (F.col("k") < k[1])


def scene(spark: SparkSession, number: int, dims: tuple[int, int, int], steps: list[tuple[str, Column]], poured: Column, up: tuple[float, float, float] = (0, 0, 1)) -> DataFrame:
    """Nodes of a scene built by adding and cutting blocks, with their neighbours; the boundary is the sink."""
    g = Raster(dims, 1.0, (0.0, 0.0, 0.0))
    cells = g.cells(spark)
    for what, mask in steps:
        cells = scenes.add(cells, mask) if what == "add" else scenes.cut(cells, mask)
    h = F.col("i") * up[0] + F.col("j") * up[1] + F.col("k") * up[2]
    source = F.when(F.col("boundary"), 0.0).otherwise(poured.cast("double"))
    return cells.filter("not solid").select(F.lit(number).cast("long").alias("scenario_id"), "node_id", h.cast("double").alias("h"), F.lit(0).alias("region"), F.col("boundary").alias("sink"), source.alias("src"), F.lit(1.0).alias("v"), F.lit(0.0).alias("e"), scenes.face_neighbours(g).alias("to"))


def bottle() -> list[tuple[str, Column]]:
    return [("add", block((2, 12), (2, 12), (2, 12))), ("cut", block((3, 11), (3, 11), (3, 11))), ("cut", block((5, 9), (5, 9), (11, 12)))]


def cascade(depth: int, second: bool = False) -> list[tuple[str, Column]]:
    """A box with a neck in its side, an open cup under the neck and, optionally, a notch in its rim with a cup below."""
    top = 12 + depth
    steps = [("add", block((4, 21), (1, 11), (20, 33))), ("cut", block((5, 20), (2, 10), (21, 32))), ("cut", block((20, 21), (4, 8), (26, 30)))]
    steps += [("add", block((20, 33), (1, 11), (12, top + 1))), ("cut", block((21, 32), (2, 10), (13, top + 1)))]
    if second:
        steps += [("cut", block((32, 33), (4, 8), (top, top + 1))), ("add", block((32, 40), (1, 11), (2, 8))), ("cut", block((33, 39), (2, 10), (3, 8)))]
    return steps


def tank(*dividers: tuple[int, int, int]) -> list[tuple[str, Column]]:
    steps = [("add", block((0, 22), (0, 6), (0, 16))), ("cut", block((1, 21), (1, 5), (1, 16)))]
    return steps + [("add", block((a, b + 1), (1, 5), (1, top + 1))) for a, b, top in dividers]


def poured_low(volume: int) -> Column:
    """The lowest cells of the left chamber (36 a layer), filled up to a volume."""
    place = (F.col("k") - 1) * 36 + (F.col("i") - 1) * 4 + F.col("j") - 1
    return F.when(block((1, 10), (1, 5), (1, 16)) & (place < volume), 1.0).otherwise(0.0)



def _scenes() -> list[tuple]:
    """(name, dims, blocks, what is poured, up)."""
    inside = lambda m: F.when(m, 1.0).otherwise(0.0)
    box = inside(block((5, 20), (2, 10), (21, 32)))
    plate = [("add", block((5, 15), (5, 15), (5, 6)))]
    tray = [*plate, ("add", block((5, 15), (5, 15), (6, 7))), ("cut", block((6, 14), (6, 14), (6, 7)))]
    on_plate = inside(block((6, 14), (6, 14), (6, 7)))
    return [
        ("bottle_full", (14, 14, 14), bottle(), inside(block((3, 11), (3, 11), (3, 11))), (1, 0, 0)),
        ("bottle_third", (14, 14, 14), bottle(), inside(block((3, 11), (3, 11), (3, 6))), (1, 0, 0)),
        ("plate", (20, 20, 12), plate, on_plate, (0, 0, 1)),
        ("tray", (20, 20, 12), tray, on_plate, (0, 0, 1)),
        ("cascade", (44, 12, 40), cascade(5), box, (0, 0, 1)),
        ("deep_cup", (44, 12, 40), cascade(10), box, (0, 0, 1)),
        ("two_stage", (44, 12, 40), cascade(5, True), box, (0, 0, 1)),
        ("merged_lake", (22, 6, 18), tank((10, 11, 6)), poured_low(512), (0, 0, 1)),
        ("saddle_40", (22, 6, 18), tank((10, 11, 6), (16, 16, 3)), poured_low(256), (0, 0, 1)),
        ("saddle_60", (22, 6, 18), tank((10, 11, 6), (16, 16, 3)), poured_low(276), (0, 0, 1)),
        ("saddle_150", (22, 6, 18), tank((10, 11, 6), (16, 16, 3)), poured_low(366), (0, 0, 1)),
    ]


def settled(spark: SparkSession, parts: list[tuple], routing: bool = True) -> DataFrame:
    """Retained volume by cell and drained volume by scene, all scenes as one ensemble."""
    nodes = reduce(DataFrame.union, (scene(spark, n, *rest) for n, (_, *rest) in enumerate(parts)))
    out = fsm.fill_spill(nodes, routing=routing)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("scenario_id") + 1).cast("int"))
    height, depth = of([p[1][2] for p in parts]), of([p[1][1] for p in parts])
    node = F.col("node_id")
    index = {"name": of([p[0] for p in parts]), "k": node % height, "j": F.floor(node / height) % depth, "i": F.floor(node / (height * depth))}
    return out.withColumns(index)


def fill_spill_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven scenes whose volumes follow from counting cells: kept, gone, in the first vessel and in what it spills into."""
    out = settled(spark, _scenes())
    name = F.col("name")
    first = F.when(name.startswith("bottle"), block((3, 5), (3, 11), (3, 11))).when(name.isin("plate", "tray"), block((6, 14), (6, 14), (6, 7))).when(name.isin("cascade", "deep_cup", "two_stage"), block((5, 20), (2, 10), (21, 32))).otherwise(block((1, 10), (1, 5), (1, 7)))
    second = F.when(name.isin("cascade", "deep_cup", "two_stage"), block((21, 39), (2, 10), (3, 23))).when(name == "merged_lake", block((12, 21), (1, 5), (1, 7))).when(name.startswith("saddle"), block((12, 16), (1, 5), (1, 4)) | block((17, 21), (1, 5), (1, 4))).otherwise(F.lit(False))
    held = lambda m: r(F.sum(F.when(m, F.col("retained")).otherwise(0.0)))
    return out.groupBy("name").agg(r(F.sum("retained")).alias("kept"), r(F.sum("drained")).alias("gone"), held(first).alias("first"), held(second).alias("second"))


def cup_spill_routing_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without routing what spills is gone, and the cup below stays empty."""
    out = settled(spark, [s for s in _scenes() if s[0] == "cascade"], routing=False)
    return out.groupBy("name").agg(r(F.sum("retained")).alias("kept"), r(F.sum("drained")).alias("gone"))


@query("SELECT p_partkey, least(floor(p_retailprice/100)::BIGINT, (p_size % 5 + 2)*3*4)::DOUBLE AS retained, (floor(p_retailprice/100)::BIGINT - least(floor(p_retailprice/100)::BIGINT, (p_size % 5 + 2)*3*4))::DOUBLE AS drained, 0.0::DOUBLE AS lost FROM part")
def cup_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cups: an upright cup keeps what it has room for, the rest runs over its rim. A scene a part."""
    w = F.col("p_size") % 5 + 2
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scenario_id"), w.cast("int").alias("w"), F.floor(F.col("p_retailprice") / 100).cast("double").alias("poured"))
    # A raster of (w + 4) x 7 x 8 cells; the cup's inside is w x 3 x 4, its walls one cell, and it stands free.
    # Cups of one width have the same cells: they are made once a width (at most nine, by the remainder) and sent to the parts.
    cells = parts.select("w").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), (F.col("w") + 4) * 56 - 1))).withColumns({"i": F.floor(F.col("c") / 56).cast("int"), "j": (F.floor(F.col("c") / 8) % 7).cast("int"), "k": (F.col("c") % 8).cast("int")})
    w = F.col("w")
    wall = lambda i, j, k: i.between(1, w + 2) & j.between(1, 5) & k.between(1, 5) & ~(i.between(2, w + 1) & j.between(2, 4) & k.between(2, 5))
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    fluid = cells.filter(~wall(i, j, k))
    edge = (i == 0) | (i == w + 3) | j.isin(0, 6) | k.isin(0, 7)
    mouth = (i == 2) & (j == 3) & (k == 5)
    steps = [(F.when((x >= 0) & (x < w + 4) & y.between(0, 6) & z.between(0, 7) & ~wall(x, y, z), x * 56 + y * 8 + z)) for x, y, z in ((i + a, j + b, k + c) for a, b, c in ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)))]
    cups = fluid.select("w", F.col("c").cast("long").alias("node_id"), k.cast("double").alias("h"), F.lit(0).alias("region"), edge.alias("sink"), mouth.alias("mouth"), F.lit(1.0).alias("v"), F.lit(0.0).alias("e"), F.array_compact(F.array(*steps)).cast("array<long>").alias("to"))
    nodes = spread(parts, "scenario_id").join(F.broadcast(cups), "w").withColumn("src", F.when(F.col("mouth"), F.col("poured")).otherwise(0.0))
    out = fsm.fill_spill(nodes)
    return out.groupBy(F.col("scenario_id").alias("p_partkey")).agg(*(r(F.sum(c)).alias(c) for c in ("retained", "drained", "lost")))


FIELD = Raster((1 << 40, 40), 1.0, (0.0, 0.0))
_FIELD = "(SELECT p_partkey AS node_id, p_partkey // 40 AS i, p_partkey % 40 AS j, floor(p_retailprice * 100)::BIGINT AS h, p_partkey % 40 IN (0, 1, 39) AS sink FROM part)"
_FIELD_LINKS = f"(SELECT a.node_id AS src, b.node_id AS dst FROM {_FIELD} a JOIN (VALUES (-40), (-1), (1), (40)) s(s) ON true JOIN {_FIELD} b ON b.node_id = a.node_id + s.s WHERE abs(a.i-b.i) + abs(a.j-b.j) = 1)"


def field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a height field of 40 columns, in whole numbers by their price; outer columns are the sink."""
    k, column = F.col("p_partkey"), F.col("p_partkey") % 40
    cells = table(spark, sf_dir, "part").select(k.alias("node_id"), F.floor(k / 40).alias("i"), column.cast("int").alias("j"), F.floor(F.col("p_retailprice") * 100).cast("long").alias("h"), column.isin(0, 1, 39).alias("sink"), F.lit(False).alias("solid"))
    return never_sent(cells.select("node_id", "h", "sink")), scenes.face_links(FIELD, cells)


_NEXT = f"""n AS MATERIALIZED (SELECT * FROM {_FIELD}), low AS (SELECT l.src, arg_min(b.node_id, CASE WHEN b.sink THEN 0 ELSE 1 END * 1e15 + b.h*1e3 + b.node_id) AS to_ FROM {_FIELD_LINKS} l JOIN n b ON b.node_id = l.dst GROUP BY 1),
 p AS (SELECT n.node_id, CASE WHEN n.sink OR (NOT t.sink AND (t.h, t.node_id) > (n.h, n.node_id)) THEN n.node_id ELSE t.node_id END AS next FROM n JOIN low ON low.src = n.node_id JOIN n t ON t.node_id = low.to_)"""


@query(f"WITH {_NEXT} SELECT * FROM p")
def steepest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.pointers(*field(spark, sf_dir))


_BASIN = f"{_NEXT}, b(node_id, basin) AS (SELECT node_id, node_id FROM p WHERE next = node_id UNION ALL SELECT p.node_id, b.basin FROM b JOIN p ON p.next = b.node_id AND p.next <> p.node_id)"


@query(f"WITH RECURSIVE {_BASIN} SELECT node_id, basin FROM b")
def basins_pointer_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.basins(fsm.pointers(*field(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {_BASIN}, c AS (SELECT l.src AS node_id, list_sort(list(DISTINCT b.basin)) AS basins FROM {_FIELD_LINKS} l JOIN n x ON x.node_id = l.src JOIN n y ON y.node_id = l.dst JOIN b ON b.node_id = l.dst
    WHERE NOT x.sink AND (y.sink OR (y.h, y.node_id) < (x.h, x.node_id)) GROUP BY 1) SELECT node_id, array_to_string(basins, ' ') AS basins FROM c WHERE len(basins) > 1"""
)
def saddle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = field(spark, sf_dir)
    out = fsm.candidates(nodes, links, fsm.basins(fsm.pointers(nodes, links)))
    return out.select("node_id", F.concat_ws(" ", F.transform("basins", lambda b: b.cast("string"))).alias("basins"))


@query(f"WITH RECURSIVE {_BASIN} SELECT a.basin AS a, c.basin AS b, min(greatest(CASE WHEN NOT x.sink THEN x.h END, CASE WHEN NOT y.sink THEN y.h END)) AS h FROM {_FIELD_LINKS} l JOIN b a ON a.node_id = l.src JOIN b c ON c.node_id = l.dst JOIN n x ON x.node_id = l.src JOIN n y ON y.node_id = l.dst WHERE a.basin < c.basin GROUP BY 1, 2")
def basin_saddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = field(spark, sf_dir)
    return fsm.saddles(nodes, links, fsm.basins(fsm.pointers(nodes, links)))


@query(
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {_FIELD}), l AS MATERIALIZED (SELECT * FROM {_FIELD_LINKS}), w(node_id, level) USING KEY (node_id) AS (SELECT node_id, CASE WHEN sink THEN -1 ELSE 1e12 END::DOUBLE FROM n UNION
    (SELECT q.node_id, min(greatest(n.h, w.level))::DOUBLE FROM recurring.w AS q JOIN n ON n.node_id = q.node_id AND NOT n.sink JOIN l ON l.dst = q.node_id JOIN w ON w.node_id = l.src GROUP BY q.node_id HAVING min(greatest(n.h, w.level)) < any_value(q.level)))
    SELECT w.node_id, h < level AND NOT sink AS held FROM w JOIN n ON n.node_id = w.node_id"""
)
def flooded_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells under water after the whole field was flooded."""
    return fsm.flooded(*field(spark, sf_dir))


def fill_spill_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rough field flooded by the kernel, cell by cell; tests hold it against the staged operator and conservation."""
    nodes, links = field(spark, sf_dir)
    one = nodes.select(F.lit(0).cast("long").alias("scenario_id"), "node_id", F.col("h").cast("double").alias("h"), F.lit(0).alias("region"), "sink", F.when(F.col("sink"), 0.0).otherwise(1.0).alias("src"), F.lit(1.0).alias("v"), F.lit(0.0).alias("e"))
    return fsm.fill_spill(one, links.withColumn("scenario_id", F.lit(0).cast("long")).select("scenario_id", "src", "dst"))
