"""Readers and writers of vectors, matrices and keypoints. Numbers in files are little-endian; the native form is Parquet."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.files import read_files, save_files

FLOATS = pa.list_(pa.float32())
#: Element types of a matrix file: code modulo 8; channels less one from bit 3 on. Fixed values of the format.
DEPTHS = {0: "u1", 1: "i1", 2: "<u2", 3: "<i2", 4: "<i4", 5: "<f4", 6: "<f8"}


def to_floats(x: np.ndarray, places: int | None = None) -> np.ndarray:
    """The nearest floats. With places, a float that rounds to other decimals than x does (halves away from zero) gives way to the next one on the other side of x.

    Numbers of unit vectors and at most 6 places: there the steps of floats are smaller than those of decimals, so that one rounds as x does.
    """

    def units(v: np.ndarray) -> np.ndarray:
        t = v * 10.0**places
        whole = np.trunc(t)
        return whole + np.sign(t) * (np.abs(t - whole) >= 0.5)

    out = x.astype("<f4")
    if places is not None:
        back = out.astype(np.float64)
        off = units(back) != units(x)
        out[off] = np.nextafter(out[off], np.where(back < x, np.inf, -np.inf).astype("<f4")[off])
    return out


def write_idvec(vectors: DataFrame, folder: str, dim: int, normalise: bool = True, places: int | None = None) -> int:
    """vectors (id, embedding) as files of `n, {length, id, dim, floats}`, one for each partition; vectors of another size are left out. The number of files.

    With places, floats round to so many decimals as the numbers did before they were cut to floats, see to_floats().
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v is None or len(v) != dim:
                    continue
                x = np.asarray(v, np.float64)
                if normalise:
                    x = x / max(float(np.sqrt(x @ x)), 1e-12)
                name = str(key).encode()
                out.append(struct.pack("<i", len(name)) + name + struct.pack("<i", dim) + to_floats(x, places).tobytes())
                n += 1
        content = struct.pack("<i", n) + b"".join(out)
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{TaskContext.get().partitionId():05}.bin"]), pa.array([content], pa.binary())], names=["name", "content"])

    return save_files(vectors.select(F.col("id").cast("string"), "embedding").mapInArrow(encode, "name string, content binary"), folder)


def read_idvec(spark: SparkSession, folder: str, dim: int) -> DataFrame:
    """id, embedding of such files; a vector of another size is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                (n,), at, ids, rows = struct.unpack_from("<i", data), 4, [], []
                for _ in range(n):
                    (size,) = struct.unpack_from("<i", data, at)
                    ids.append(data[at + 4 : at + 4 + size].decode())
                    at += 4 + size
                    (d,) = struct.unpack_from("<i", data, at)
                    if d != dim:
                        raise ValueError(f"a vector of {d} dimensions in a file of {dim}")
                    rows.append(np.frombuffer(data, "<f4", dim, at + 4))
                    at += 4 + 4 * dim
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, FLOATS)], names=["id", "embedding"])

    return read_files(spark, folder).mapInArrow(decode, "id string, embedding array<float>")


def read_csv_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """id, embedding of lines `id,f1,..,fd`; lines with another number of fields are left out, a field that is no number is an error."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p")).where(F.size("p") == dim + 1)
    return parts.select(F.get("p", F.lit(0)).alias("id"), F.transform(F.slice("p", 2, dim), lambda x: F.trim(x).cast("float")).alias("embedding"))


def read_raw_floats(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """frame, embedding of files of floats and nothing else. Records have one size, so files are split over tasks; frames count over all files in order."""
    numbered = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))  # no DataFrame source splits a file of fixed records
    rows = spark.createDataFrame(numbered, "frame long, data binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4")
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x))], names=["frame", "embedding"])

    return rows.mapInArrow(decode, "frame long, embedding array<float>")


def write_raw_floats(vectors: DataFrame, folder: str, order: str) -> int:
    """One file of the vectors in order; for moderate tables, as one task writes it."""
    packed = vectors.orderBy(order).select("embedding").coalesce(1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = b"".join(np.asarray(v, "<f4").tobytes() for batch in batches for v in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(["frames.raw"]), pa.array([content], pa.binary())], names=["name", "content"])

    return save_files(packed.mapInArrow(encode, "name string, content binary"), folder)


def encode_matrix(x: np.ndarray) -> bytes:
    """rows, cols, type, elements; a matrix without elements is one zero."""
    if not x.size:
        return struct.pack("<i", 0)
    channels = x.shape[2] if x.ndim == 3 else 1
    code = next(k for k, d in DEPTHS.items() if np.dtype(d) == x.dtype.newbyteorder("<"))
    return struct.pack("<3i", x.shape[0], x.shape[1], code | channels - 1 << 3) + np.ascontiguousarray(x).tobytes()


def decode_matrix(data: bytes) -> np.ndarray:
    (rows,) = struct.unpack_from("<i", data)
    if not rows:
        return np.empty((0, 0), np.float32)
    cols, code = struct.unpack_from("<2i", data, 4)
    channels = (code >> 3) + 1
    x = np.frombuffer(data, DEPTHS[code & 7], rows * cols * channels, 12)
    return x.reshape(rows, cols) if channels == 1 else x.reshape(rows, cols, channels)


def write_matrices(rows: DataFrame, folder: str) -> int:
    """rows (name, row int, values array<float>) as a matrix file for each name; the rows of a matrix are gathered, as a file is one row."""
    gathered = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("row", "values"))).alias("rows")).select("name", F.transform("rows", lambda r: r["values"]).alias("rows"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [encode_matrix(np.array(x, np.float32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["name", "content"])

    return save_files(gathered.mapInArrow(encode, "name string, content binary"), folder)


def read_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """name, row, values of one-channel matrix files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = decode_matrix(data).astype(np.float64)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]] * len(x)), pa.array(range(len(x)), pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["name", "row", "values"])

    return read_files(spark, folder).mapInArrow(decode, "name string, row int, values array<double>")


#: The two orders of a keypoint's fields; fixed values of the formats.
KEYPOINT_ORDERS = {
    "angle_first": (("angle", "size", "response", "class_id", "octave", "x", "y"), "<3f2i2f"),
    "point_first": (("x", "y", "angle", "size", "response", "class_id", "octave"), "<5f2i"),
}
KEYPOINT = "x float, y float, angle float, size float, response float, class_id int, octave int"
FIELDS = ("x", "y", "angle", "size", "response", "class_id", "octave")


def write_keypoints(points: DataFrame, folder: str, order: str = "point_first") -> int:
    """points (name, idx and the fields) as a file for each name: an eight-byte count and the keypoints by idx."""
    names, layout = KEYPOINT_ORDERS[order]
    gathered = points.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("idx", *names))).alias("p"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [struct.pack("<Q", len(p)) + b"".join(struct.pack(layout, *(k[f] for f in names)) for k in p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["name", "content"])

    return save_files(gathered.mapInArrow(encode, "name string, content binary"), folder)


def read_keypoints(spark: SparkSession, folder: str, order: str = "point_first") -> DataFrame:
    """name, idx and the fields."""
    names, layout = KEYPOINT_ORDERS[order]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (n,) = struct.unpack_from("<Q", data)
                rows = [dict(zip(names, r, strict=True)) for r in struct.iter_unpack(layout, data[8 : 8 + n * struct.calcsize(layout)])]
                columns = [pa.array([r[f] for r in rows], pa.int32() if f in ("class_id", "octave") else pa.float32()) for f in FIELDS]
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]] * n, pa.string()), pa.array(range(n), pa.int32()), *columns], names=["name", "idx", *FIELDS])

    return read_files(spark, folder).mapInArrow(decode, f"name string, idx int, {KEYPOINT}")


def write_geoinfo(points: DataFrame, folder: str) -> int:
    """points (name, id, relate_id and keypoint fields) as files of `n, {length, name, id, relate_id, keypoint}`, one for each partition."""
    layout = KEYPOINT_ORDERS["point_first"][1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for r in batch.to_pylist():
                name = r["name"].encode()
                out.append(struct.pack("<i", len(name)) + name + struct.pack("<2i", r["id"], r["relate_id"]) + struct.pack(layout, *(r[f] for f in FIELDS)))
        content = struct.pack("<i", len(out)) + b"".join(out)
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{TaskContext.get().partitionId():05}.geo"]), pa.array([content], pa.binary())], names=["name", "content"])

    return save_files(points.select("name", "id", "relate_id", *FIELDS).mapInArrow(encode, "name string, content binary"), folder)


def read_geoinfo(spark: SparkSession, folder: str) -> DataFrame:
    layout = KEYPOINT_ORDERS["point_first"][1]
    schema = f"name string, id int, relate_id int, {KEYPOINT}"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                (n,), at, rows = struct.unpack_from("<i", data), 4, []
                for _ in range(n):
                    (size,) = struct.unpack_from("<i", data, at)
                    head = (data[at + 4 : at + 4 + size].decode(), *struct.unpack_from("<2i", data, at + 4 + size))
                    rows.append((*head, *struct.unpack_from(layout, data, at + 12 + size)))
                    at += 12 + size + struct.calcsize(layout)
                types = [pa.string(), pa.int32(), pa.int32(), *[pa.float32()] * 5, pa.int32(), pa.int32()]
                columns = list(zip(*rows, strict=True)) or [()] * 10
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["name", "id", "relate_id", *FIELDS])

    return read_files(spark, folder).mapInArrow(decode, schema)


def read_feature_text(spark: SparkSession, folder: str, dim: int = 128) -> DataFrame:
    """name, idx, x, y, scale, orientation, descriptor (0 to 255) of text files with `n dim` and then a line for each feature.

    Another dim, a value out of range, or fewer lines than n are errors; lines after the first n are not read.
    """
    lines = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.split(F.regexp_replace("value", r"\r", ""), "\n").alias("lines"))
    head = F.split(F.trim(F.get("lines", F.lit(0))), r"\s+")
    n = F.get(head, F.lit(0)).cast("int")
    right = F.when((F.get(head, F.lit(1)).cast("int") == dim) & (F.size("lines") > n), F.slice("lines", 2, n)).otherwise(F.raise_error(F.concat(F.lit("features of another size, or too few: "), F.col("name"))))
    parts = lines.select("name", F.posexplode(right).alias("idx", "line")).select("name", "idx", F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("float")).alias("v"))
    value = F.slice("v", 5, dim)
    checked = F.when((F.size("v") >= dim + 4) & F.forall(value, lambda x: (x >= 0) & (x <= 255)), F.transform(value, lambda x: F.floor(x).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("a descriptor out of range: "), F.col("name"))))
    return parts.select("name", "idx", *(F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("x", "y", "scale", "orientation"))), checked.alias("descriptor"))


def write_feature_text(features: DataFrame, folder: str, dim: int = 128) -> int:
    """A text file for each name; features: name, idx, x, y, scale, orientation, descriptor."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x", "y", "scale", "orientation")), F.array_join(F.transform("descriptor", lambda x: x.cast("string")), " "))
    rows = features.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("r"))
    text = F.concat(F.size("r").cast("string"), F.lit(f" {dim}\n"), F.array_join(F.transform("r", lambda r: r["line"]), "\n"), F.lit("\n"))
    return save_files(rows.select("name", text.cast("binary").alias("content")), folder)


def encode_pgm(x: np.ndarray, most: int = 255) -> bytes:
    """A grey image as binary PGM; two bytes a pixel, the high one first, if most is over 255."""
    return b"P5\n%d %d\n%d\n" % (x.shape[1], x.shape[0], most) + x.astype(">u2" if most > 255 else "u1").tobytes()


def decode_pgm(data: bytes) -> np.ndarray:
    """Binary or plain PGM; comments are skipped."""
    at, words = 0, []
    while len(words) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words.append(data[at:end])
        at = end
    kind, cols, rows, most = words[0], *map(int, words[1:])
    if kind == b"P2":
        return np.array(data[at:].split()[: rows * cols], np.uint16).reshape(rows, cols)
    if kind != b"P5":
        raise ValueError("no PGM file")
    return np.frombuffer(data, ">u2" if most > 255 else "u1", rows * cols, at + 1).reshape(rows, cols).astype(np.uint16)


def read_pgm(spark: SparkSession, folder: str) -> DataFrame:
    """name, rows, cols, pixels (row by row) of PGM images."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [decode_pgm(d) for d in batch.column(1).to_pylist()]
            names = [p.rsplit("/", 1)[1] for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(x) for x in images], pa.int32()), pa.array([x.shape[1] for x in images], pa.int32()), pa.array([x.ravel().astype(np.int32) for x in images], pa.list_(pa.int32()))], names=["name", "rows", "cols", "pixels"])

    return read_files(spark, folder).mapInArrow(decode, "name string, rows int, cols int, pixels array<int>")
