"""Where pixels, frames and tensors come in: decoders that are not part of this library are asked for when they are used.

Each reader gives arrays as columns, so that what follows (keypoints, masks, hashes, features) is plain DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.sources.files import read_files

IMAGE = "name string, rows int, cols int, channels int, pixels binary"
FRAME = "name string, frame long, rows int, cols int, pixels binary"


def decoder(module: str, purpose: str):
    try:
        return import_module(module)
    except ImportError as e:
        raise RuntimeError(f"{purpose} needs the package {module}, which is not installed") from e


def read_images(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Decoded images, eight bits a channel, row by row."""
    decoder("PIL.Image", "reading images")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from io import BytesIO

        image = decoder("PIL.Image", "reading images")
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with image.open(BytesIO(data)) as im:
                    im = im if im.mode in ("L", "RGB") else im.convert("RGB")
                    row = [[path.rsplit("/", 1)[1]], [im.height], [im.width], [len(im.getbands())], [im.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["name", "rows", "cols", "channels", "pixels"])

    return read_files(spark, folder, glob).mapInArrow(run, IMAGE)


def read_video(spark: SparkSession, folder: str, every: int = 1, glob: str | None = None) -> DataFrame:
    """Every n-th frame of video files, in RGB; frames are given as they are decoded, one at a time."""
    decoder("av", "reading video")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from io import BytesIO

        av = decoder("av", "reading video")
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with av.open(BytesIO(data)) as video:
                    for n, frame in enumerate(video.decode(video=0)):
                        if n % every == 0:
                            x = frame.to_ndarray(format="rgb24")
                            row = [[path.rsplit("/", 1)[1]], [n], [x.shape[0]], [x.shape[1]], [x.tobytes()]]
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["name", "frame", "rows", "cols", "pixels"])

    return read_files(spark, folder, glob).mapInArrow(run, FRAME)


def read_hdf5(spark: SparkSession, path: str, dataset: str, rows_a_task: int = 100_000) -> DataFrame:
    """row, embedding of a two-dimensional dataset of a file that all tasks can open, in ranges of rows."""
    h5 = decoder("h5py", "reading HDF5")
    with h5.File(path, "r") as f:
        n = f[dataset].shape[0]
    starts = spark.range(0, n, rows_a_task, max(1, -(-n // rows_a_task)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with decoder("h5py", "reading HDF5").File(path, "r") as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    x = f[dataset][first : first + rows_a_task]
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(x)), pa.int64()), pa.array(list(x.astype("f8")), pa.list_(pa.float64()))], names=["row", "embedding"])

    return starts.mapInArrow(run, "row long, embedding array<double>")


def run_model(batches: DataFrame, model: bytes, column: str, size: int, rows: int = 64) -> DataFrame:
    """id, output of an ONNX model over a column of float arrays, in groups of `rows` with a remainder. The model is sent once; its input is (n, size)."""
    decoder("onnxruntime", "running a model")
    sent = batches.sparkSession.sparkContext.broadcast(model)  # a model file

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        session = decoder("onnxruntime", "running a model").InferenceSession(sent.value)
        name = session.get_inputs()[0].name
        for batch in parts:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = np.array(part.column(1).to_pylist(), np.float32).reshape(-1, size)
                out = np.asarray(session.run(None, {name: x})[0], np.float64).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["id", "output"])

    return batches.select("id", column).mapInArrow(run, "id long, output array<double>")
