import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import geometry as G
from tarnflow.sources import formats

CUBE = np.array([[[0, 0, 0], [0, 1, 0], [1, 1, 0]], [[0, 0, 0], [1, 1, 0], [1, 0, 0]], [[0, 0, 1], [1, 0, 1], [1, 1, 1]], [[0, 0, 1], [1, 1, 1], [0, 1, 1]], [[0, 0, 0], [1, 0, 0], [1, 0, 1]], [[0, 0, 0], [1, 0, 1], [0, 0, 1]], [[0, 1, 0], [0, 1, 1], [1, 1, 1]], [[0, 1, 0], [1, 1, 1], [1, 1, 0]], [[0, 0, 0], [0, 0, 1], [0, 1, 1]], [[0, 0, 0], [0, 1, 1], [0, 1, 0]], [[1, 0, 0], [1, 1, 0], [1, 1, 1]], [[1, 0, 0], [1, 1, 1], [1, 0, 1]]], float)


def text(path, name, content):
    (path / name).write_text(content)
    return str(path / name)


def test_stl(spark, tmp_path):
    (tmp_path / "cube.stl").write_bytes(formats.stl_bytes(CUBE))
    (tmp_path / "mm.stl").write_bytes(formats.stl_bytes(CUBE * 200))
    (tmp_path / "none.stl").write_bytes(b"")
    faces = formats.read_stl(spark, str(tmp_path / "*.stl"))
    one = faces.filter(F.col("file").endswith("cube.stl"))
    assert one.count() == 12 and faces.count() == 24
    assert faces.filter(F.col("file").endswith("mm.stl")).agg(F.max("ax")).first()[0] == pytest.approx(0.2)
    corners = [[F.col(f"{v}{c}") for c in "xyz"] for v in "abc"]
    centroid, normal, area = G.face_geometry(*corners)
    flux = G.dot(centroid, normal) * area / 3
    row = one.agg(F.sum(area), F.sum(flux)).first()
    assert row[0] == pytest.approx(6) and row[1] == pytest.approx(1)
    vertices, by_vertex = formats.indexed(one)
    assert vertices.count() == 8 and by_vertex.count() == 12


def test_lists_and_collections(spark, tmp_path):
    seals = formats.read_seals(spark, text(tmp_path, "seals.csv", "name,x,y,z,radius_mm\na,1,2,3,40\n")).collect()
    assert [tuple(r) for r in seals] == [(1.0, 2.0, 3.0, 0.04)]
    holes = spark.createDataFrame([(1.0, 2.0, 3.0, 0.012, 1), (0.0, 0.0, 0.0, 0.2, -1), (4.0, 0.0, 0.0, 0.01, 0)], "x double, y double, z double, diameter double, kind int")
    formats.write_holes(holes, f"{tmp_path}/holes")
    back = formats.read_holes(spark, f"{tmp_path}/holes")
    assert sorted((r.x, r.diameter, r.kind) for r in back.collect()) == sorted((r.x, r.diameter, r.kind) for r in holes.collect())
    assert [r.kind for r in formats.holes_in_range(back, [1], 0.01, 0.05).collect()] == [1]
    runs = formats.read_experiment(spark, text(tmp_path, "runs.csv", "# measured\nA,2,0.2,0.8\nA,1,0.1,0.9\nB,1,0.5,0.5\n")).collect()
    assert {r.run: [s.t for s in r.series] for r in runs} == {"A": [1.0, 2.0], "B": [1.0]}
    entries = spark.createDataFrame([(0.5, "b.vtp"), (0.25, "a.vtp")], "t double, file string")
    formats.write_collection(spark, entries, f"{tmp_path}/all.pvd")
    assert sorted(map(tuple, formats.read_collection(spark, f"{tmp_path}/all.pvd").collect())) == [(0.25, "a.vtp"), (0.5, "b.vtp")]
    motion = text(tmp_path, "m.xml", '<Motion><Frame Time="1" Q0="1" Q1="0" Q2="0" Q3="0" X="1" Y="2" Z="3"/><Frame Time="0" Q0="1" Q1="0" Q2="0" Q3="0" X="0" Y="0" Z="0"/></Motion>')
    assert [(r.t, r.z) for r in formats.read_motion(spark, motion).collect()] == [(0.0, 0.0), (1.0, 3.0)]
    text(tmp_path, "r1.jsonl", '{"case": "a", "v": 1}\n{"case": "b", "v": 2}\n')
    assert formats.read_results(spark, f"{tmp_path}/r*.jsonl").count() == 2


def test_recordings_and_saved_states(spark, tmp_path):
    fields = spark.createDataFrame([(0, "liquid", 1, 0.5), (0, "liquid", 2, 0.001), (1, "air", 3, 2.0)], "step int, kind string, cell long, value double")
    formats.write_recording(fields.filter("step = 0"), f"{tmp_path}/rec", {"dx": 0.1})
    formats.write_recording(fields.filter("step = 1"), f"{tmp_path}/rec", {"dx": 0.1}, last=True)
    back, meta = formats.read_recording(spark, f"{tmp_path}/rec")
    assert meta == {"dx": 0.1, "done": True}
    assert sorted((r.step, r.kind, r.cell, r.q) for r in back.collect()) == [(0, "liquid", 1, 128), (1, "air", 3, 255)]
    q = formats.follow_recording(spark, f"{tmp_path}/rec").groupBy("step").count().writeStream.format("memory").queryName("rec").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("rec").collect())) == [(0, 1), (1, 1)]
    formats.save_tables({"a": fields, "b": fields.limit(0)}, f"{tmp_path}/state", 3, {"t": 1.5})
    tables, extra = formats.load_tables(spark, f"{tmp_path}/state", 3)
    assert tables["a"].count() == 3 and tables["b"].count() == 0 and extra == {"t": 1.5}
    with pytest.raises(ValueError):
        formats.load_tables(spark, f"{tmp_path}/state", 4)


def test_text_output(spark, tmp_path):
    cells = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(2) for j in range(3)], "i int, j int, f double")
    formats.write_points(cells, (2, 3), 0.5, (0.0, 0.0), ["f"], f"{tmp_path}/p.vtk")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/p.vtk").collect()]
    assert lines[0].startswith("# vtk") and lines[-6:] == ["0.0", "10.0", "1.0", "11.0", "2.0", "12.0"]
    nodes = spark.createDataFrame([(1, 1e-6, 0.002, 0.0, 0.0, 0.0), (1, 3e-6, 0.004, 1.0, 1.0, 1.0)], "channel int, volume double, width double, x double, y double, z double")
    mouths = spark.createDataFrame([(1, 0.1, 2), (1, 0.05, 0)], "channel int, length double, joins int")
    formats.export_channels(nodes, mouths, f"{tmp_path}/ch")
    assert spark.read.csv(f"{tmp_path}/ch", header=True).first().asDict() == {"channel": "1", "nodes": "2", "volume_ml": "4.000", "width_mm": "3.50", "x": "0.7500", "y": "0.7500", "z": "0.7500", "mouths": "2", "mouth_mm": "150.0", "joins": "0 2"}
