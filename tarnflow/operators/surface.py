"""Triangle meshes: samples, patches, ring-shaped holes, gaps between facing walls, and the channels they form."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.operators import near
from tarnflow.operators.bodies import upper_median
from tarnflow.operators.components import connected_components


def corners() -> list[list[Column]]:
    return [[F.col(f"{v}{c}") for c in "xyz"] for v in "abc"]


def with_geometry(faces: DataFrame) -> DataFrame:
    """Adds centroid (x, y, z), unit normal (nx, ny, nz) and area."""
    centroid, normal, area = G.face_geometry(*corners())
    return faces.withColumns(dict(zip(("x", "y", "z", "nx", "ny", "nz", "area"), [*centroid, *normal, area], strict=True)))


def edges(by_vertex: DataFrame) -> DataFrame:
    """(u, v, face_id): the three edges of each face, u < v."""
    pairs = [F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in ((F.col("v0"), F.col("v1")), (F.col("v1"), F.col("v2")), (F.col("v2"), F.col("v0")))]
    return by_vertex.select("face_id", F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v", "face_id")


def face_pairs(by_vertex: DataFrame) -> DataFrame:
    """(src, dst): faces that share an edge; more than two at an edge are a chain in the order of their ids."""
    w = W.partitionBy("u", "v").orderBy("face_id")
    return edges(by_vertex).withColumn("src", F.lag("face_id").over(w)).filter(F.col("src").isNotNull()).select("src", F.col("face_id").alias("dst"))


def free_edges(by_vertex: DataFrame) -> DataFrame:
    """(u, v): edges of one face only."""
    return edges(by_vertex).groupBy("u", "v").count().filter("count = 1").select("u", "v")


def smooth_patches(faces: DataFrame, pairs: DataFrame, sharp: float = 30.0) -> DataFrame:
    """(face_id, patch): faces joined over edges whose normals turn by less than ``sharp`` degrees; a patch is its lowest face."""
    n = faces.select("face_id", "nx", "ny", "nz")
    a, b = (n.select(F.col("face_id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("nx", "ny", "nz"))) for end in ("src", "dst"))
    turn = G.dot([F.col(f"{c}_src") for c in ("nx", "ny", "nz")], [F.col(f"{c}_dst") for c in ("nx", "ny", "nz")])
    cc = connected_components(pairs.join(a, "src").join(b, "dst").filter(turn > math.cos(math.radians(sharp))).select("src", "dst"))
    return faces.select("face_id").join(cc.withColumnRenamed("node", "face_id"), "face_id", "left").select("face_id", F.coalesce("component", "face_id").alias("patch"))


RING = "patch long, x double, y double, z double, ax double, ay double, az double, diameter double, roundness double, gap_deg double, depth double, kind int, nfaces int"


def ring_patches(faces: DataFrame, patches: DataFrame, least: float, most: float, roundest: float = 0.1, largest_gap: float = 60.0) -> DataFrame:
    """Patches that are the inside (kind 1: a hole) or outside (-1: a pin) of a short cylinder: the axis is the direction that
    their normals avoid, the radius the mean distance from it. A patch is one group; patches of many faces are flat or large
    and are left out first by a bound on their extent, which an aggregate gives."""
    f = faces.join(patches, "face_id")
    small = f.groupBy("patch").agg(*(F.max(c).alias(f"h{c}") for c in "xyz"), *(F.min(c).alias(f"l{c}") for c in "xyz"), F.count(F.lit(1)).alias("n"))
    small = small.filter(F.greatest(*(F.col(f"h{c}") - F.col(f"l{c}") for c in "xyz")) <= 1.5 * most).filter("n >= 6").select("patch")

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, area = pdf[["x", "y", "z"]].to_numpy(), pdf[["nx", "ny", "nz"]].to_numpy(), pdf["area"].to_numpy()
        ok = np.isfinite(n).all(axis=1) & (area > 0)
        x, n, area = x[ok], n[ok], area[ok]
        none = pd.DataFrame(columns=[c.split()[0] for c in RING.split(", ")])
        if len(x) < 6:
            return none
        values, vectors = np.linalg.eigh((n * area[:, None]).T @ n)
        axis = vectors[:, 0]
        if values[0] > 0.05 * values.sum():
            return none
        basis = vectors[:, 1:]
        p = x @ basis
        # The axis passes where the faces' normals meet: least squares of (c - p) x n = 0 in the plane.
        m = n @ basis
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        q = area[:, None, None] * (np.eye(2) - m[:, :, None] * m[:, None, :])
        centre = np.linalg.lstsq(q.sum(axis=0), (q @ p[:, :, None]).sum(axis=0)[:, 0], rcond=None)[0]
        d = p - centre
        radius = np.linalg.norm(d, axis=1)
        mean = float((radius * area).sum() / area.sum())
        spread = float(np.sqrt((area * (radius - mean) ** 2).sum() / area.sum()) / max(mean, 1e-12))
        angles = np.sort(np.degrees(np.arctan2(d[:, 1], d[:, 0])))
        gap = float(np.max(np.diff(np.append(angles, angles[0] + 360))))
        inward = float((area * np.sign((m * d).sum(axis=1))).sum() / area.sum())
        kind = 1 if inward < -0.8 else -1 if inward > 0.8 else 0
        if not least <= 2 * mean <= most or spread > roundest or gap > largest_gap:
            return none
        along = x @ axis
        where = (centre @ basis.T) + axis * float((along * area).sum() / area.sum())
        depth = float(along.max() - along.min())
        return pd.DataFrame([[pdf["patch"].iloc[0], *where, *axis, 2 * mean, spread, gap, depth, kind, len(x)]], columns=none.columns)

    return f.join(small, "patch", "left_semi").select("patch", "x", "y", "z", "nx", "ny", "nz", "area").groupBy("patch").applyInPandas(ring, RING)


def face_samples(faces: DataFrame, spacing: float) -> DataFrame:
    """(face_id, sample, x, y, z, nx, ny, nz, area): points spread evenly over each face (the R2 sequence, folded into the
    triangle), two a square of ``spacing`` and one a spacing of the longest edge at least, a single one at the centre;
    their areas add up to the face's. A large face is dealt into runs of samples first, so no row holds them all."""
    a, b, c = corners()
    longest = F.greatest(*(G.length(G.minus(p, q)) for p, q in ((a, b), (b, c), (c, a))))
    n = F.greatest(F.lit(1), F.ceil(2 * F.col("area") / (spacing * spacing)), F.ceil(longest / spacing)).cast("long")
    g, run = 1.32471795724474602596, 4096
    df = faces.withColumn("_n", n).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / run))))
    df = df.withColumn("sample", F.explode(F.sequence(F.col("_r") * run + 1, F.least(F.col("_n"), (F.col("_r") + 1) * run))))
    u, v = (0.5 + (F.col("sample") - 1) / g) % 1.0, (0.5 + (F.col("sample") - 1) / (g * g)) % 1.0
    fold, one = u + v > 1, F.col("_n") == 1
    u, v = (F.when(one, 1 / 3).when(fold, 1 - w).otherwise(w) for w in (u, v))
    p = [x + u * (y - x) + v * (z - x) for x, y, z in zip(a, b, c, strict=True)]
    return df.select("face_id", "sample", *(q.alias(k) for q, k in zip(p, "xyz", strict=True)), "nx", "ny", "nz", (F.col("area") / F.col("_n")).alias("area"))


def lattice(faces: DataFrame, spacing: float) -> DataFrame:
    """(face_id, x, y, z): the points of a barycentric lattice whose steps are at most ``spacing`` along each edge."""
    a, b, c = corners()
    longest = F.greatest(*(G.length(G.minus(p, q)) for p, q in ((a, b), (b, c), (c, a))))
    df = faces.withColumn("_n", F.greatest(F.lit(1), F.ceil(longest / spacing)).cast("int"))
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("_i"))))
    u, v = F.col("_i") / F.col("_n"), F.col("_j") / F.col("_n")
    return df.select("face_id", *((x + u * (y - x) + v * (z - x)).alias(k) for x, y, z, k in zip(a, b, c, "xyz", strict=True)))


def cells_of_faces(faces: DataFrame, dx: float, origin: Sequence[float], dims: Sequence[int]) -> DataFrame:
    """(face_id, i, j, k) of every cell that a triangle touches: candidates from its box, kept by the separating-axis test."""
    df = faces
    for axis, o, n in zip("xyz", origin, dims, strict=True):
        lo = F.floor((F.least(*(F.col(f"{v}{axis}") for v in "abc")) - o) / dx - 1e-9)
        hi = F.floor((F.greatest(*(F.col(f"{v}{axis}") for v in "abc")) - o) / dx + 1e-9)
        lo, hi = F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(n - 1)).cast("int")
        df = df.withColumn(f"_{axis}", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    centre = G.centre([F.col(f"_{a}") for a in "xyz"], dx, origin)
    hit = G.triangle_meets_box(centre, [0.5 * dx] * 3, *corners())
    return df.filter(hit).select("face_id", *(F.col(f"_{a}").alias(k) for a, k in zip("xyz", "ijk", strict=True)))


def first_hits(samples: DataFrame, faces: DataFrame, reach: float, cell: float) -> DataFrame:
    """(face_id, sample, width, partner, facing): the first face that a sample's ray along its normal meets within ``reach``.

    Rays and faces meet in buckets of ``cell``: a ray visits the buckets along it, a face those of its box, so no ray is
    compared with all faces. A wall faces the sample if it looks back."""
    steps = math.ceil(2 * reach / cell) + 1
    at = samples.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("_t", F.col("_s") * (reach / steps))
    keys = [F.floor((F.col(c) + F.col("_t") * F.col(f"n{c}")) / cell).cast("long") for c in "xyz"]
    rays = at.select("face_id", "sample", "x", "y", "z", "nx", "ny", "nz", *(k.alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
    walls = faces.select(F.col("face_id").alias("partner"), *(f"{v}{c}" for v in "abc" for c in "xyz"), *(F.col(f"n{c}").alias(f"m{c}") for c in "xyz"))
    for i, c in enumerate("xyz"):
        lo = F.floor(F.least(*(F.col(f"{v}{c}") for v in "abc")) / cell) - 1
        hi = F.floor(F.greatest(*(F.col(f"{v}{c}") for v in "abc")) / cell) + 1
        walls = walls.withColumn(f"_k{i}", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    both = rays.join(walls, ["_k0", "_k1", "_k2"]).filter("partner <> face_id")
    t = G.ray_distance([F.col(c) for c in "xyz"], [F.col(f"n{c}") for c in "xyz"], *corners())
    back = G.dot([F.col(f"n{c}") for c in "xyz"], [F.col(f"m{c}") for c in "xyz"]) < 0
    hit = both.withColumn("width", t).filter((F.col("width") <= reach) & F.col("width").isNotNull())
    return hit.groupBy("face_id", "sample").agg(F.min(F.struct("width", "partner", back.alias("facing"))).alias("h")).select("face_id", "sample", "h.width", "h.partner", "h.facing")


def gap_samples(faces: DataFrame, spacing: float, reach: float) -> DataFrame:
    """Samples of all faces with the gap in front of them; width, partner and facing are null where nothing is near."""
    s = face_samples(faces, spacing)
    return s.join(first_hits(s, faces, reach, max(reach, spacing)), ["face_id", "sample"], "left")


def gap_regions(samples: DataFrame, lo: float, hi: float, spacing: float) -> DataFrame:
    """Regions of facing samples with a gap in [lo, hi): joined within 1.5 spacings along one sheet. (region, area, least and
    upper median width, centroid, extent), the largest area first."""
    band = samples.filter(F.col("facing") & (F.col("width") >= lo) & (F.col("width") < hi)).withColumn("id", F.xxhash64("face_id", "sample"))
    pairs = near.radius_join(band.select("id", "x", "y", "z", "nx", "ny", "nz"), band.select("id", "x", "y", "z", "nx", "ny", "nz"), "xyz", 1.5 * spacing)
    sheet = G.same_surface([F.col(f"r_{c}") - F.col(c) for c in "xyz"], [F.col(f"n{c}") for c in "xyz"], [F.col(f"r_n{c}") for c in "xyz"], spacing)
    cc = connected_components(pairs.filter(sheet & (F.col("id") < F.col("r_id"))).select(F.col("id").alias("src"), F.col("r_id").alias("dst")))
    df = band.join(cc.withColumnRenamed("node", "id"), "id", "left").withColumn("region", F.coalesce("component", "id"))
    weight = F.sum("area")
    out = df.groupBy("region").agg(weight.alias("area"), F.min("width").alias("least"), upper_median("width").alias("median"), *((F.sum(F.col(c) * F.col("area")) / weight).alias(c) for c in "xyz"), *((F.max(c) - F.min(c)).alias(f"extent_{c}") for c in "xyz"))
    return out.orderBy(F.col("area").desc(), "region")


def edge_samples(samples: DataFrame, spacing: float) -> DataFrame:
    """For samples (id, label, x, y, z, nx, ny, nz): the nearest sample of no or another label on the same sheet, one in each
    octant of directions: what lies beyond a region's edge."""
    s = samples.select("id", "label", "x", "y", "z", "nx", "ny", "nz")
    pairs = near.radius_join(s.filter("label is not null"), s, "xyz", 1.5 * spacing).filter("r_label is null or r_label <> label")
    d = [F.col(f"r_{c}") - F.col(c) for c in "xyz"]
    pairs = pairs.filter(G.same_surface(d, [F.col(f"n{c}") for c in "xyz"], [F.col(f"r_n{c}") for c in "xyz"], spacing))
    octant = sum(((c > 0).cast("int") * 2**k for k, c in enumerate(d)), F.lit(0))
    w = W.partitionBy("id", octant).orderBy("distance", "r_id")
    return pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", "label", F.col("r_id").alias("beyond"), "distance")


def channel_nodes(samples: DataFrame, size: float) -> DataFrame:
    """(channel, node, volume, width, x, y, z): gap samples of channels gathered in cubes of ``size`` round the middle of the
    gap; a gap seen from both walls counts half from each."""
    mid = [F.col(c) + 0.5 * F.col("width") * F.col(f"n{c}") for c in "xyz"]
    keys = [F.floor(m / size).cast("long") for m in mid]
    held = F.col("area") * F.col("width") * F.when(F.col("facing"), 0.5).otherwise(1.0)
    df = samples.select("channel", "width", held.alias("v"), *(m.alias(c) for m, c in zip(mid, "xyz", strict=True)), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    total = F.sum("v")
    return df.groupBy("channel", "k0", "k1", "k2").agg(total.alias("volume"), *((F.sum(F.col(c) * F.col("v")) / total).alias(c) for c in ("width", "x", "y", "z"))).withColumn("node", F.xxhash64("channel", "k0", "k1", "k2")).drop("k0", "k1", "k2")


def crossings(points: DataFrame, targets: DataFrame, faces: DataFrame) -> DataFrame:
    """(point, target): the candidate target (point, target, x, y, z) that the fewest faces hide, then the nearest, for each
    point (point, x, y, z, cell); a point whose best view still crosses an odd number of faces lies inside metal and is
    left out. ``faces`` come by cell, so a sight line meets the faces of its point's cell only."""
    p = points.select("point", "cell", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    lines = p.join(targets.select("point", "target", *(F.col(c).alias(f"q{c}") for c in "xyz")), "point")
    hit = G.segment_meets_triangle([F.col(f"p{c}") for c in "xyz"], [F.col(f"q{c}") for c in "xyz"], *corners())
    crossed = lines.join(faces, "cell", "left").groupBy("point", "target").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("n"), F.first(G.length(G.minus([F.col(f"p{c}") for c in "xyz"], [F.col(f"q{c}") for c in "xyz"]))).alias("d"))
    best = crossed.groupBy("point").agg(F.min(F.struct("n", "d", "target")).alias("b"))
    return best.filter("b.n % 2 = 0").select("point", "b.target", F.col("b.n").alias("crossings"))


def smoothed(vertices: DataFrame, pairs: DataFrame, rounds: int = 6, shrink: float = 0.5, grow: float = -0.53) -> DataFrame:
    """Vertices (id, x, y, z) moved towards and away from the mean of their neighbours in turn, which keeps the volume."""
    from tarnflow.operators.session import round_of

    both = pairs.select("src", "dst").union(pairs.select("dst", "src")).distinct()
    at = vertices
    for k in range(2 * rounds):
        rate = shrink if k % 2 == 0 else grow
        mean = both.join(at.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
        at = at.join(mean, "id", "left").select("id", *((F.col(c) + rate * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in "xyz"))
        if k % 4 == 3:
            at = round_of(at)
    return at


def strips(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, length): extent of each group's points along their main direction."""

    def main(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = pdf[["x", "y", "z"]].to_numpy()
        x = x - x.mean(axis=0)
        _, _, vt = np.linalg.svd(x, full_matrices=False)
        on = x @ vt[0]
        return pdf[list(keys)].head(1).assign(length=float(on.max() - on.min()))

    fields = [f for f in points.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", length double"
    return points.select(*keys, "x", "y", "z").groupBy(*keys).applyInPandas(main, schema)
