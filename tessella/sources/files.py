"""Files that Spark has no writer for: a row a file, written by the tasks; and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        base = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row (name string, content binary) to a file of the folder; name, bytes of what was written.

    A file appears under its name when it is whole: a task that runs again, or twice at a time, writes the same file anew.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, LocalFileSystem

        system, root = FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                part = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{root}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select("name", "content").mapInArrow(put, "name string, bytes long")


def save_files(files: DataFrame, folder: str) -> int:
    """write_files() at once; the number of files."""
    return write_files(files, folder).agg(F.count(F.lit(1))).first()[0]


def read_files(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, content of the files; a file is one row of at most 2 GB."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder).select("path", "content")


def paths(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, bytes of the files in the order of their paths; contents are not read. Files without content are left out, as Spark does."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder).select("path", F.col("length").alias("bytes")).orderBy("path")
