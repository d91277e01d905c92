"""How densely faces are sampled: the reference's counts, without a cap."""

import math

from tarnflow.operators import surface


def test_counts_follow_area_and_longest_edge(spark):
    shapes = {0: (0.0001, 0.0001), 1: (1.0, 0.0001), 2: (1.0, 1.0), 3: (0.03, 0.02)}
    rows = [(k, 0.0, 0.0, 0.0, x, 0.0, 0.0, 0.0, y, 0.0, 0.0, 0.0, 1.0, x * y / 2) for k, (x, y) in shapes.items()]
    names = "face_id long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz") + ", nx double, ny double, nz double, area double"
    faces = spark.createDataFrame(rows, names)
    got = {}
    for r in surface.face_samples(faces, 0.01).collect():
        got.setdefault(r.face_id, []).append(r)
    for k, (x, y) in shapes.items():
        assert len(got[k]) == max(math.ceil(x * y / 0.01**2), math.ceil(math.hypot(x, y) / 0.01), 1)
        assert sorted(r["sample"] for r in got[k]) == list(range(1, len(got[k]) + 1))
        assert abs(sum(r.area for r in got[k]) - x * y / 2) < 1e-9
    assert abs(got[0][0].x - 0.0001 / 3) < 1e-12 and abs(got[0][0].y - 0.0001 / 3) < 1e-12
    n = math.ceil(math.hypot(1.0, 0.0001) / 0.001)
    assert surface.lattice(faces.filter("face_id = 1"), 0.001).count() == (n + 1) * (n + 2) // 2
