"""Sparse models: cameras, images with their points, and points with their tracks, as text or binary files.

cameras: camera_id, model, width, height, params array<double>. images: image_id, qvec, tvec array<double>, camera_id, name,
points2d array<struct<x, y, point3d_id>> (-1: none). points: point3d_id, xyz array<double>, rgb array<int>, error,
track array<struct<image_id, point2d_idx>>.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.files import read_files, save_files

#: Camera models: number, name and number of parameters. Fixed values of the format.
MODELS = {
    "SIMPLE_PINHOLE": (0, 3), "PINHOLE": (1, 4), "SIMPLE_RADIAL": (2, 4), "RADIAL": (3, 5), "OPENCV": (4, 8), "OPENCV_FISHEYE": (5, 8), "FULL_OPENCV": (6, 12),
    "FOV": (7, 5), "SIMPLE_RADIAL_FISHEYE": (8, 4), "RADIAL_FISHEYE": (9, 5), "THIN_PRISM_FISHEYE": (10, 12),
}
NO_POINT = 0xFFFFFFFFFFFFFFFF
POINT2D = "array<struct<x:double,y:double,point3d_id:bigint>>"
TRACK = "array<struct<image_id:bigint,point2d_idx:int>>"
CAMERAS = "camera_id long, model string, width long, height long, params array<double>"
IMAGES = f"image_id long, qvec array<double>, tvec array<double>, camera_id long, name string, points2d {POINT2D}"
POINTS = f"point3d_id long, xyz array<double>, rgb array<int>, error double, track {TRACK}"


def _fields(df: DataFrame, line: str = "line") -> DataFrame:
    return df.withColumn("p", F.split(F.trim(F.col(line)), r"\s+"))


def _numbers(first: int, n: int):
    return F.transform(F.slice("p", first, n), lambda v: v.cast("double"))


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')"))


def _unit(q):
    n = F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(q, lambda x: x / n)


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    """A known model has its number of parameters, or the read is an error."""
    sizes = F.create_map(*(F.lit(x) for name, (_, n) in MODELS.items() for x in (name, n)))
    c = _data_lines(spark, path)
    model = F.get("p", F.lit(1))
    right = F.when(F.try_element_at(sizes, model) == F.size("p") - 4, model).otherwise(F.raise_error(F.concat(F.lit("parameters of a camera: "), F.col("line"))))
    return c.select(F.get("p", F.lit(0)).cast("long").alias("camera_id"), right.alias("model"), F.get("p", F.lit(2)).cast("long").alias("width"), F.get("p", F.lit(3)).cast("long").alias("height"), F.transform(F.slice("p", 5, F.greatest(F.size("p") - 4, F.lit(0))), lambda v: v.cast("double")).alias("params"))


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Two lines an image, the second of which may be empty; so lines are paired within whole files."""
    lines = spark.read.text(path, wholetext=True).select(F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", ""))).alias("all"))
    # From the first line of data on, a line that begins an image is one that is neither blank nor a comment where one is due.
    data = lines.select(F.filter("all", lambda x: ~x.startswith("#")).alias("all")).select(F.expr("slice(all, greatest(array_position(transform(all, x -> x <> ''), true), 1), size(all))").cast("array<string>").alias("all"))
    pairs = data.select(F.explode(F.expr("transform(sequence(0, cast((size(all) + 1) div 2 as int) - 1), i -> struct(all[2 * i] AS line, coalesce(get(all, 2 * i + 1), '') AS points))")).alias("i")).select("i.*").where("line <> ''")
    p = _fields(pairs)
    points = F.when(F.col("points") == "", F.array().cast(POINT2D)).otherwise(F.expr(f"cast(transform(sequence(0, cast(size(split(points, ' +')) div 3 as int) - 1), i -> named_struct('x', cast(split(points, ' +')[3 * i] as double), 'y', cast(split(points, ' +')[3 * i + 1] as double), 'point3d_id', cast(split(points, ' +')[3 * i + 2] as bigint))) as {POINT2D})"))
    return p.select(F.get("p", F.lit(0)).cast("long").alias("image_id"), _unit(_numbers(2, 4)).alias("qvec"), _numbers(6, 3).alias("tvec"), F.get("p", F.lit(8)).cast("long").alias("camera_id"), F.get("p", F.lit(9)).alias("name"), points.alias("points2d"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    p = _data_lines(spark, path)
    n = F.floor((F.size("p") - 8) / 2).cast("int")
    track = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get("p", 8 + 2 * i).cast("long").alias("image_id"), F.get("p", 9 + 2 * i).cast("int").alias("point2d_idx")))).otherwise(F.array().cast(TRACK))
    return p.select(F.get("p", F.lit(0)).cast("long").alias("point3d_id"), _numbers(2, 3).alias("xyz"), F.transform(F.slice("p", 5, 3), lambda v: v.cast("int")).alias("rgb"), F.get("p", F.lit(7)).cast("double").alias("error"), track.alias("track"))


def write_cameras_text(cameras: DataFrame, path: str) -> None:
    cameras.select(F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), F.array_join(F.transform("params", lambda v: v.cast("string")), " "))).write.text(path)


def write_images_text(images: DataFrame, path: str) -> None:
    points = F.array_join(F.transform("points2d", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["point3d_id"].cast("string"))), " ")
    head = F.concat_ws(" ", F.col("image_id").cast("string"), F.array_join(F.transform(F.concat("qvec", "tvec"), lambda v: v.cast("string")), " "), F.col("camera_id").cast("string"), "name")
    images.select(F.concat(head, F.lit("\n"), points)).write.text(path)


def write_points_text(points: DataFrame, path: str) -> None:
    track = F.array_join(F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["point2d_idx"].cast("string"))), " ")
    numbers = F.array_join(F.concat(F.transform("xyz", lambda v: v.cast("string")), F.transform("rgb", lambda v: v.cast("string"))), " ")
    points.select(F.rtrim(F.concat_ws(" ", F.col("point3d_id").cast("string"), numbers, F.col("error").cast("string"), track))).write.text(path)


def _camera_bytes(r: dict) -> bytes:
    return struct.pack("<Ii2Q", r["camera_id"], MODELS[r["model"]][0], r["width"], r["height"]) + struct.pack(f"<{len(r['params'])}d", *r["params"])


def _image_bytes(r: dict) -> bytes:
    head = struct.pack("<I7d", r["image_id"], *r["qvec"], *r["tvec"]) + struct.pack("<I", r["camera_id"]) + r["name"].encode() + b"\0"
    return head + struct.pack("<Q", len(r["points2d"])) + b"".join(struct.pack("<2dQ", p["x"], p["y"], NO_POINT if p["point3d_id"] < 0 else p["point3d_id"]) for p in r["points2d"])


def _point_bytes(r: dict) -> bytes:
    return struct.pack("<Q3d3Bd", r["point3d_id"], *r["xyz"], *r["rgb"], r["error"]) + struct.pack("<Q", len(r["track"])) + b"".join(struct.pack("<2I", t["image_id"], t["point2d_idx"]) for t in r["track"])


def _read_cameras(data: bytes) -> Iterator[tuple]:
    names = {k: (name, n) for name, (k, n) in MODELS.items()}
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        key, model, width, height = struct.unpack_from("<Ii2Q", data, at)
        name, n = names[model]
        yield key, name, width, height, list(struct.unpack_from(f"<{n}d", data, at + 24))
        at += 24 + 8 * n


def _read_images(data: bytes) -> Iterator[tuple]:
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        key, *pose = struct.unpack_from("<I7d", data, at)
        (camera,) = struct.unpack_from("<I", data, at + 60)
        end = data.index(b"\0", at + 64)
        (n,) = struct.unpack_from("<Q", data, end + 1)
        points = [{"x": x, "y": y, "point3d_id": -1 if p == NO_POINT else p} for x, y, p in struct.iter_unpack("<2dQ", data[end + 9 : end + 9 + 24 * n])]
        q = np.array(pose[:4]) / max(float(np.linalg.norm(pose[:4])), 1e-300)
        yield key, q.tolist(), pose[4:], camera, data[at + 64 : end].decode(), points
        at = end + 9 + 24 * n


def _read_points(data: bytes) -> Iterator[tuple]:
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        key, x, y, z, r, g, b, error = struct.unpack_from("<Q3d3Bd", data, at)
        (n,) = struct.unpack_from("<Q", data, at + 43)
        yield key, [x, y, z], [r, g, b], error, [{"image_id": i, "point2d_idx": j} for i, j in struct.iter_unpack("<2I", data[at + 51 : at + 51 + 8 * n])]
        at += 51 + 8 * n


KINDS = {"cameras": (CAMERAS, _camera_bytes, _read_cameras), "images": (IMAGES, _image_bytes, _read_images), "points": (POINTS, _point_bytes, _read_points)}


def write_binary(table: DataFrame, folder: str, kind: str) -> int:
    """A count of eight bytes and the records, a file for each partition. kind: cameras, images or points."""
    from pyspark import TaskContext

    schema, encode, _ = KINDS[kind]
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [encode(r) for batch in batches for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f"{kind}-{TaskContext.get().partitionId():05}.bin"]), pa.array([struct.pack("<Q", len(out)) + b"".join(out)], pa.binary())], names=["name", "content"])

    return save_files(table.select(*columns).mapInArrow(run, "name string, content binary"), folder)


def read_binary(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl, _, decode = KINDS[kind]
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                if rows := list(decode(data)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

    return read_files(spark, folder, f"{kind}*").mapInArrow(run, ddl)


def write_ply(points: DataFrame, folder: str, binary: bool = False) -> int:
    """points (name, idx, x, y, z, r, g, b) as a PLY point cloud for each name."""
    kinds = [*(("float", c) for c in "xyz"), *(("uchar", c) for c in ("red", "green", "blue"))]
    header = "".join(f"property {t} {c}\n" for t, c in kinds)
    gathered = points.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "z", "r", "g", "b"))).alias("p"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for rows in batch.column(1).to_pylist():
                values = [[r[c] for c in "xyzrgb"] for r in rows]
                body = b"".join(struct.pack("<3f3B", *v) for v in values) if binary else "".join(" ".join([*(f"{np.float32(x):.9g}" for x in v[:3]), *map(str, v[3:])]) + "\n" for v in values).encode()
                content.append(f"ply\nformat {'binary_little_endian' if binary else 'ascii'} 1.0\nelement vertex {len(rows)}\n{header}end_header\n".encode() + body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["name", "content"])

    return save_files(gathered.mapInArrow(encode, "name string, content binary"), folder)


#: Names of number types in a PLY header. Fixed values of the format.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
PLY_NAMES = {"red": "r", "green": "g", "blue": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b"}


def decode_ply(data: bytes) -> dict[str, np.ndarray]:
    """The vertex properties by name; other elements must come after the vertices and are not read."""
    end = data.index(b"end_header\n") + 11
    order, n, names, inside = "", 0, [], False
    for line in data[:end].decode().split("\n"):
        w = line.split()
        if w[:1] == ["format"]:
            order = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            names.append((PLY_NAMES.get(w[2], w[2]), PLY_TYPES[w[1]]))
    if order == "ascii":
        table = np.array(data[end:].split()[: n * len(names)], float).reshape(n, len(names))
        return {c: table[:, i] for i, (c, _) in enumerate(names)}
    dtype = np.dtype([(c, ("<" if "little" in order else ">") + t) for c, t in names])
    table = np.frombuffer(data, dtype, n, end)
    return {c: table[c] for c, _ in names}


def read_ply(spark: SparkSession, folder: str) -> DataFrame:
    """name, idx, x, y, z, r, g, b of PLY point clouds in text or binary; colours that are not there are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = decode_ply(data)
                n = len(p["x"])
                colours = [pa.array(np.asarray(p.get(c, np.zeros(n)), np.int32)) for c in "rgb"]
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]] * n, pa.string()), pa.array(range(n), pa.int32()), *(pa.array(np.asarray(p[c], np.float64)) for c in "xyz"), *colours], names=["name", "idx", *"xyzrgb"])

    return read_files(spark, folder).mapInArrow(run, "name string, idx int, x double, y double, z double, r int, g int, b int")
