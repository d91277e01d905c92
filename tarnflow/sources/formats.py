"""File formats: STL meshes, CSV lists of seals and holes, XML motions and collections, measured runs, VTK output,
recordings and saved states. Readers return DataFrames and read where Spark can read; nothing is unpickled."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACES = "file string, face_id long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz")
#: How a hole's kind is written.
KINDS = {1: "hole", -1: "pin", 0: "unclear"}


def read_stl(spark: SparkSession, path: str, scale: float | None = None) -> DataFrame:
    """Triangles of binary STL files (file, face_id, corners a, b, c). Without a scale, a file more than 100 units wide is
    taken to be in millimetres."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                raw = content.as_buffer()
                n = int(np.frombuffer(raw, "<u4", 1, 80)[0]) if raw.size >= 84 else 0
                n = min(n, (raw.size - 84) // 50) if n else 0
                record = np.frombuffer(raw, np.dtype([("normal", "<f4", 3), ("v", "<f4", (3, 3)), ("attribute", "<u2")]), n, 84) if n else None
                v = record["v"].astype(np.float64) if n else np.zeros((0, 3, 3))
                wide = float((v.max(axis=(0, 1)) - v.min(axis=(0, 1))).max()) if n else 0.0
                v = v * (scale if scale is not None else 0.001 if wide > 100 else 1.0)
                for at in range(0, n, 50_000):
                    part = v[at : at + 50_000].reshape(-1, 9)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(at, at + len(part))), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(9))], schema=_arrow(FACES))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, FACES)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def stl_bytes(corners: np.ndarray) -> bytes:
    """A binary STL of triangles (n, 3, 3)."""
    v = np.asarray(corners, np.float32)
    n = np.cross(v[:, 1] - v[:, 0], v[:, 2] - v[:, 0])
    length = np.linalg.norm(n, axis=1, keepdims=True)
    record = np.zeros(len(v), np.dtype([("normal", "<f4", 3), ("v", "<f4", (3, 3)), ("attribute", "<u2")]))
    record["normal"], record["v"] = np.divide(n, length, out=np.zeros_like(n), where=length > 0), v
    return b"binary".ljust(80) + struct.pack("<I", len(v)) + record.tobytes()


def indexed(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces by vertex): equal corners are one vertex, numbered by their coordinates' hash, so no sort of all is needed."""
    corner = lambda v: F.struct(*(F.col(f"{v}{c}").alias(c) for c in "xyz"))
    name = lambda v: F.xxhash64(*(F.col(f"{v}{c}") + F.lit(0.0) for c in "xyz"))
    vertices = faces.select(F.explode(F.array(*map(corner, "abc"))).alias("p")).select(F.xxhash64(*(F.col(f"p.{c}") + F.lit(0.0) for c in "xyz")).alias("vertex_id"), "p.*").dropDuplicates(["vertex_id"])
    return vertices, faces.select("face_id", *(name(v).alias(f"v{k}") for k, v in enumerate("abc")))


def read_seals(spark: SparkSession, path: str) -> DataFrame:
    """Spheres (x, y, z, radius) of a CSV with columns x, y, z and radius_mm; other columns are ignored."""
    df = spark.read.csv(path, header=True)
    return df.select(*(F.col(c).cast("double").alias(c) for c in "xyz"), (F.col("radius_mm").cast("double") / 1000).alias("radius"))


def read_holes(spark: SparkSession, path: str) -> DataFrame:
    """Holes of a CSV as ``write_holes`` writes it; the kind comes back as 1, -1 or 0."""
    kind = F.create_map(*(F.lit(x) for code, text in KINDS.items() for x in (text, code)))
    df = spark.read.csv(path, header=True)
    numbers = [F.col(c).cast("double").alias(c) for c in df.columns if c != "kind"]
    return df.select(*numbers, F.coalesce(F.try_element_at(kind, F.col("kind")), F.lit(0)).alias("kind"))


def write_holes(holes: DataFrame, path: str) -> None:
    """One CSV with six decimals a number."""
    kind = F.create_map(*(F.lit(x) for code, text in KINDS.items() for x in (code, text)))
    cols = [F.element_at(kind, F.col(c).cast("int")).alias(c) if c == "kind" else F.format_string("%.6f", F.col(c).cast("double")).alias(c) for c in holes.columns]
    holes.select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True)


def holes_in_range(holes: DataFrame, kinds: Sequence[int], least: float, most: float) -> DataFrame:
    return holes.filter(F.col("kind").isin(list(kinds)) & F.col("diameter").between(least, most))


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a measured drainage: (run, series array<struct<t, v_out, v_left>> by time); lines that begin with # are comments."""
    df = spark.read.schema("run string, t double, v_out double, v_left double").csv(path, comment="#", header=False, mode="DROPMALFORMED")
    return df.filter(F.col("t").isNotNull()).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("t", "v_out", "v_left"))).alias("series"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(t, file) of a PVD collection."""
    schema = "_timestep double, _file string"
    return spark.read.format("xml").option("rowTag", "DataSet").schema(schema).load(path).select(F.col("_timestep").alias("t"), F.col("_file").alias("file"))


def write_collection(spark: SparkSession, entries: DataFrame, path: str) -> None:
    """A PVD collection, a line an entry."""
    line = F.format_string('<DataSet timestep="%s" file="%s"/>', F.col("t").cast("string"), "file")
    ends = spark.createDataFrame([(0, '<?xml version="1.0"?><VTKFile type="Collection" version="0.1"><Collection>'), (2, "</Collection></VTKFile>")], "o int, value string")
    body = entries.select(F.lit(1).alias("o"), line.alias("value"), "t").unionByName(ends, allowMissingColumns=True)
    body.coalesce(1).sortWithinPartitions("o", "t").select("value").write.mode("overwrite").text(path)


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """Frames (t, quaternion q0..q3, translation x, y, z) of a motion XML with Frame elements, by time."""
    attrs = ["Time", "Q0", "Q1", "Q2", "Q3", "X", "Y", "Z"]
    schema = ", ".join(f"_{a} double" for a in attrs)
    df = spark.read.format("xml").option("rowTag", "Frame").schema(schema).load(path)
    return df.select(F.col("_Time").alias("t"), *(F.col(f"_{a}").alias(a.lower()) for a in attrs[1:])).orderBy("t")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result lines of JSON files."""
    return spark.read.json(path)


# ---- VTK


def write_points(cells: DataFrame, dims: Sequence[int], dx: float, origin: Sequence[float], fields: Sequence[str], path: str) -> None:
    """A legacy structured-points text file of cell fields; cells are ordered by a range partitioning, first axis fastest."""
    spark = cells.sparkSession
    whole = [*dims, *[1] * (3 - len(dims))]
    head = ["# vtk DataFile Version 3.0", "cells", "ASCII", "DATASET STRUCTURED_POINTS", "DIMENSIONS " + " ".join(str(n + 1) for n in whole), "ORIGIN " + " ".join(map(str, [*origin, *[0.0] * (3 - len(dims))])), f"SPACING {dx} {dx} {dx}", f"CELL_DATA {int(np.prod(whole))}"]
    index = ["i", "j", "k"][: len(dims)]
    place = F.lit(0).cast("long")
    for a, n in zip(reversed(index), reversed(dims), strict=True):
        place = place * n + F.col(a)
    out = spark.createDataFrame([(0, n, line) for n, line in enumerate(head)], "part int, place long, value string")
    for k, f in enumerate(fields, 1):
        out = out.unionByName(spark.createDataFrame([(k, -2, f"SCALARS {f} double 1"), (k, -1, "LOOKUP_TABLE default")], out.schema)).unionByName(cells.select(F.lit(k).alias("part"), place.alias("place"), F.col(f).cast("double").cast("string").alias("value")))
    out.coalesce(1).sortWithinPartitions("part", "place").select("value").write.mode("overwrite").text(path)


# ---- recordings and saved states


def quantised(field: Column) -> Column:
    return F.rint(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), field))).cast("int")


def write_recording(fields: DataFrame, path: str, meta: dict[str, object], last: bool = False) -> None:
    """Appends steps (step, kind, cell, value) as sparse eighths of a byte, a folder a step; ``meta`` is written beside them,
    and ``last`` leaves a marker that no more will come."""
    spark = fields.sparkSession
    kept = fields.withColumn("q", quantised(F.col("value"))).filter("q > 0").select("step", "kind", "cell", "q")
    kept.repartition("step").write.mode("append").partitionBy("step").parquet(f"{path}/fields")
    text = spark.createDataFrame([(json.dumps(meta | {"done": last}, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_recording(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, object]]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return spark.read.parquet(f"{path}/fields").withColumn("value", F.col("q") / 255.0), meta


def follow_recording(spark: SparkSession, path: str) -> DataFrame:
    """A recording that is still being written, as a stream of its fields."""
    schema = T.StructType.fromDDL("kind string, cell long, q int, step int")
    return spark.readStream.schema(schema).parquet(f"{path}/fields")


def save_tables(tables: dict[str, DataFrame], path: str, version: int, extra: dict[str, object] | None = None) -> None:
    """A saved state: each table as Parquet, then a manifest, whose presence makes it whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = json.dumps({"version": version, "tables": sorted(tables), "extra": extra or {}})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_tables(spark: SparkSession, path: str, version: int) -> tuple[dict[str, DataFrame], dict[str, object]]:
    found = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if found["version"] != version:
        raise ValueError(f"saved by version {found['version']}, read by {version}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in found["tables"]}, found["extra"]


def export_channels(nodes: DataFrame, mouths: DataFrame, path: str) -> None:
    """One CSV line a channel: nodes, volume in millilitres, mean width, mouths, their length, what they join, centroid."""
    n = nodes.groupBy("channel").agg(F.count(F.lit(1)).alias("nodes"), F.format_string("%.3f", F.sum("volume") * 1e6).alias("volume_ml"), F.format_string("%.2f", 1000 * F.sum(F.col("width") * F.col("volume")) / F.sum("volume")).alias("width_mm"), *(F.format_string("%.4f", F.sum(F.col(c) * F.col("volume")) / F.sum("volume")).alias(c) for c in "xyz"))
    m = mouths.groupBy("channel").agg(F.count(F.lit(1)).alias("mouths"), F.format_string("%.1f", 1000 * F.sum("length")).alias("mouth_mm"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_set("joins")), lambda c: c.cast("string"))).alias("joins"))
    n.join(m, "channel", "left").orderBy("channel").coalesce(1).write.mode("overwrite").csv(path, header=True)


def upright(vertices: DataFrame) -> list[list[float]]:
    """Rows of the rotation that puts a mesh's vertices (x, y, z) upright: the longest axis along x, the next along y, the
    shortest along z; the narrower end of z is up, and what is up there lies towards -x. Three aggregates, nothing else is read."""
    at = ["x", "y", "z"]
    box = vertices.agg(*(F.max(a).alias(f"hi_{a}") for a in at), *(F.min(a).alias(f"lo_{a}") for a in at)).first()
    order = sorted(range(3), key=lambda k: -(box[f"hi_{at[k]}"] - box[f"lo_{at[k]}"]))
    rows = [[1.0 if k == axis else 0.0 for k in range(3)] for axis in order]
    if order in ([0, 2, 1], [1, 0, 2], [2, 1, 0]):  # a mirror image
        rows[1] = [-v for v in rows[1]]

    def turned() -> DataFrame:
        return vertices.select(*(sum(F.col(a) * w for a, w in zip(at, row, strict=True)).alias(b) for b, row in zip("pqr", rows, strict=True)))

    def ends() -> tuple[DataFrame, float, float]:
        df = turned()
        low, high = df.agg(F.percentile("r", F.lit(0.1)).alias("a"), F.percentile("r", F.lit(0.9)).alias("b")).first()
        return df, low, high

    width = lambda c, on: F.percentile(F.when(on, F.col(c)), F.lit(0.98)) - F.percentile(F.when(on, F.col(c)), F.lit(0.02))
    df, low, high = ends()
    top, bottom = df.agg(width("q", F.col("r") > high).alias("a"), width("q", F.col("r") < low).alias("b")).first()
    if top is not None and bottom is not None and top > bottom:
        rows[1:] = [[-v for v in row] for row in rows[1:]]
    df, _, high = ends()
    up = F.when(F.col("r") > high, F.col("p"))
    middle = df.agg((F.percentile(up, F.lit(0.02)) + F.percentile(up, F.lit(0.98))).alias("m")).first()["m"]
    if middle is not None and middle > 0:
        rows[:2] = [[-v for v in row] for row in rows[:2]]
    return [[v + 0.0 for v in row] for row in rows]
