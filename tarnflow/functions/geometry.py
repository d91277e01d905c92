"""Row-wise geometry as Columns: rasters and their keys, shapes, poses, triangles."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column | float]


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def dot(a: Vec, b: Vec) -> Column:
    """Products added in axis order."""
    return reduce(lambda s, t: s + t, (_c(x) * _c(y) for x, y in zip(a, b, strict=True)))


def minus(a: Vec, b: Vec) -> list[Column]:
    return [_c(x) - _c(y) for x, y in zip(a, b, strict=True)]


def plus(a: Vec, b: Vec) -> list[Column]:
    return [_c(x) + _c(y) for x, y in zip(a, b, strict=True)]


def times(a: Vec, k: Column | float) -> list[Column]:
    return [_c(x) * _c(k) for x in a]


def cross(a: Vec, b: Vec) -> list[Column]:
    a, b = [_c(x) for x in a], [_c(x) for x in b]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


# ---- rasters: flat ids run with the last axis fastest


def flat_key(index: Sequence[Column], dims: Sequence[int]) -> Column:
    key = index[0].cast("long")
    for i, n in zip(index[1:], dims[1:], strict=True):
        key = key * n + i
    return key


def coords_of(key: Column, dims: Sequence[int]) -> list[Column]:
    out = []
    for n in reversed(dims[1:]):
        out.append((key % n).cast("int"))
        key = F.floor(key / n)
    return [key.cast("int"), *reversed(out)]


def dims_at(dims: Sequence[int], level: int) -> list[int]:
    return [n >> level for n in dims]


def centre(index: Sequence[Column], dx: float, origin: Sequence[float]) -> list[Column]:
    return [F.lit(o) + (i + 0.5) * dx for i, o in zip(index, origin, strict=True)]


def on_boundary(index: Sequence[Column], dims: Sequence[int]) -> Column:
    return reduce(lambda a, b: a | b, ((i == 0) | (i == n - 1) for i, n in zip(index, dims, strict=True)))


# ---- shapes: predicates on a point


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def in_box(x: Vec, lo: Vec, hi: Vec) -> Column:
    return _all((_c(p) >= _c(a)) & (_c(p) <= _c(b)) for p, a, b in zip(x, lo, hi, strict=True))


def in_ball(x: Vec, middle: Vec, radius: Column | float) -> Column:
    return length(minus(x, middle)) <= _c(radius)


#: Fixed value: by how much a thinnest wall is wider than half a cell's diagonal.
MARGIN = 1.01


def tightest(axes: int, dx: float) -> float:
    """The radius from which a wall has no gap between cells that share a face."""
    return MARGIN * math.hypot(*[dx / 2] * axes)


def beside(x: Vec, a: Vec, b: Vec) -> tuple[Column, Column, Column]:
    """Of a point and the line through a and b: how far along it is, in units of their distance squared, that square, and the
    point's squared distance from the line (from a if they are one point)."""
    way, there = minus(b, a), minus(x, a)
    along, square = dot(there, way), dot(way, way)
    off = F.greatest(dot(there, there) - F.when(square > 0, along * along / square).otherwise(0.0), F.lit(0.0))
    return along, square, off


def in_capsule(x: Vec, a: Vec, b: Vec, radius: Column | float) -> Column:
    """Within a radius of the segment: of an end before and behind it, of the line between."""
    along, square, off = beside(x, a, b)
    r2 = _c(radius) * _c(radius)
    return F.when(along <= 0, length(minus(x, a)) <= _c(radius)).when(along >= square, length(minus(x, b)) <= _c(radius)).otherwise(off <= r2)


def in_polyline(x: Vec, points: Sequence[Vec], radius: Column | float) -> Column:
    """Within a radius of any piece of the line through the points."""
    return _any(in_capsule(x, a, b, radius) for a, b in zip(points[:-1], points[1:], strict=True))


def in_cylinder(x: Vec, a: Vec, b: Vec, radius: Column | float) -> Column:
    """Between the planes through both ends, within a radius of the axis."""
    along, square, off = beside(x, a, b)
    return (along >= 0) & (along <= square) & (off <= _c(radius) * _c(radius))


def in_shell(x: Vec, lo: Vec, hi: Vec, wall: Column | float, without: Sequence[tuple[int, int]] = ()) -> Column:
    """In a box and nearer than ``wall`` to one of its faces; faces ``without`` (axis, -1 or 1) have no wall."""
    faces = [(axis, side) for axis in range(len(lo)) for side in (-1, 1) if (axis, side) not in set(without)]
    depth = {-1: lambda k: _c(x[k]) - _c(lo[k]), 1: lambda k: _c(hi[k]) - _c(x[k])}
    return in_box(x, lo, hi) & _any(depth[side](axis) < _c(wall) for axis, side in faces)


def on_circle(middle: Vec, radius: Column | float, n: Column, of: int) -> list[Column]:
    """The n-th of a number of corners of a circle in the plane, from the first axis on."""
    angle = F.radians(360.0 / of * n)
    return [_c(middle[0]) + _c(radius) * F.cos(angle), _c(middle[1]) + _c(radius) * F.sin(angle)]


# ---- poses


def rotation(angles: Vec) -> list[list[Column]]:
    """Rows of Rz Ry Rx from degrees; with one angle, the plane rotation."""
    if len(angles) == 1:
        c, s = F.cos(F.radians(_c(angles[0]))), F.sin(F.radians(_c(angles[0])))
        return [[c, -s], [s, c]]
    cx, cy, cz = (F.cos(F.radians(_c(a))) for a in angles)
    sx, sy, sz = (F.sin(F.radians(_c(a))) for a in angles)
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def up_vector(angles: Vec) -> list[Column]:
    """The world's up in object coordinates: the last row of the rotation."""
    return rotation(angles)[-1]


def bath_height(up: Vec, shift_up: Column | float, pivot: Sequence[float], level: float) -> Column:
    """Height of the bath along ``up`` in object coordinates."""
    return F.lit(level) - (F.lit(float(pivot[-1])) + _c(shift_up)) + dot(up, pivot)


def to_world(x: Vec, angles: Vec, shift: Vec, pivot: Sequence[float]) -> list[Column]:
    rel = minus(x, pivot)
    return [dot(row, rel) + p + _c(s) for row, p, s in zip(rotation(angles), pivot, shift, strict=True)]


def to_model(x: Vec, rows: Sequence[Sequence[float]], centre_: Sequence[float], vectors: bool = False) -> list[Column]:
    rel = [_c(v) for v in x] if vectors else minus(x, centre_)
    return [dot(rel, row) for row in rows]


def from_model(x: Vec, rows: Sequence[Sequence[float]], centre_: Sequence[float], vectors: bool = False) -> list[Column]:
    turned = [dot(x, [row[k] for row in rows]) for k in range(3)]
    return turned if vectors else plus(turned, centre_)


def height_nm(x: Vec, up: Vec) -> Column:
    """Height along ``up`` in whole nanometres."""
    return F.rint(dot(x, up) * 1e9).cast("long")


def rounded_pose(up: Vec, level: Column) -> tuple[list[Column], Column]:
    return [F.rint(_c(u) * 1e12) / 1e12 for u in up], F.rint(level * 1e9) / 1e9


def half_extent(size: Column | float, up: Vec) -> Column:
    return 0.5 * _c(size) * reduce(lambda a, b: a + b, (F.abs(_c(u)) for u in up))


# ---- triangles


def normal_of(a: Vec, b: Vec, c: Vec) -> list[Column]:
    return cross(minus(b, a), minus(c, a))


def face_geometry(a: Vec, b: Vec, c: Vec) -> tuple[list[Column], list[Column], Column]:
    """(centroid, unit normal by winding, area); the normal of a face without area is null."""
    n = normal_of(a, b, c)
    twice = length(n)
    return times(plus(plus(a, b), c), 1 / 3), [F.try_divide(v, twice) for v in n], 0.5 * twice


def link_face(x: Vec, y: Vec, size_x: Column, size_y: Column) -> tuple[list[Column], list[Column], Column]:
    """(centre, normal, area) of the face between linked cubes of sizes of their own: on the smaller cube's side, across the
    axis along which they lie farthest apart (the first on ties), pointing from x to y."""
    d = minus(y, x)
    apart = [F.abs(c) for c in d]
    most = F.greatest(*apart)
    main = F.when(apart[0] == most, 0).when(apart[1] == most, 1).otherwise(2)
    small = F.least(size_x, size_y)
    normal = [F.when(main == k, F.signum(c)).otherwise(0.0) for k, c in enumerate(d)]
    own = size_x <= size_y
    centre_ = [F.when(own, a + n * small / 2).otherwise(b - n * small / 2) for a, b, n in zip(x, y, normal, strict=True)]
    return centre_, normal, small * small


def triangle_meets_box(centre_: Vec, half: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Separating axes of a triangle and an axis-aligned box: three box faces, the triangle's plane, nine edge crosses."""
    v = [minus(p, centre_) for p in (a, b, c)]
    edges = [minus(v[(k + 1) % 3], v[k]) for k in range(3)]
    axes = [[F.lit(float(i == k)) for i in range(3)] for k in range(3)]
    axes += [cross(edges[0], edges[1])] + [cross([F.lit(float(i == k)) for i in range(3)], e) for k in range(3) for e in edges]
    apart = F.lit(False)
    for axis in axes:
        reach = reduce(lambda s, t: s + t, (_c(h) * F.abs(x) for h, x in zip(half, axis, strict=True)))
        on = [dot(p, axis) for p in v]
        apart = apart | (F.least(*on) > reach) | (F.greatest(*on) < -reach)
    return ~apart


def segment_meets_triangle(p: Vec, q: Vec, a: Vec, b: Vec, c: Vec, tol: float = 1e-9) -> Column:
    """Whether the segment p-q crosses a triangle (Möller-Trumbore)."""
    d, e1, e2 = minus(q, p), minus(b, a), minus(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    s = minus(p, a)
    u = F.try_divide(dot(s, h), det)
    k = cross(s, e1)
    v, t = F.try_divide(dot(d, k), det), F.try_divide(dot(e2, k), det)
    return F.coalesce((F.abs(det) > 1e-30) & (u >= -tol) & (v >= -tol) & (u + v <= 1 + tol) & (t >= -tol) & (t <= 1 + tol), F.lit(False))


def ray_distance(p: Vec, d: Vec, a: Vec, b: Vec, c: Vec, tol: float = 1e-9) -> Column:
    """Distance along the ray p + t d to a triangle, null without a hit ahead."""
    e1, e2 = minus(b, a), minus(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    s = minus(p, a)
    k = cross(s, e1)
    u, v, t = F.try_divide(dot(s, h), det), F.try_divide(dot(d, k), det), F.try_divide(dot(e2, k), det)
    return F.when((F.abs(det) > 1e-30) & (u >= -tol) & (v >= -tol) & (u + v <= 1 + tol) & (t > tol), t)


def same_surface(d: Vec, n1: Vec, n2: Vec, spacing: Column | float) -> Column:
    """Whether two samples apart by d lie on one side of one sheet."""
    return (dot(n1, n2) > 0.5) & (F.abs(dot(d, n1)) < 0.5 * _c(spacing))
