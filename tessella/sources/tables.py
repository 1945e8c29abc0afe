"""Tables of other stores: SQLite files, keyed bytes, and indexes as versioned folders."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is set on every connection: reading only, and nothing is made durable.
PRAGMAS = ("query_only = ON", "synchronous = OFF", "temp_store = MEMORY")


def _connect(path: str) -> sqlite3.Connection:
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    for p in PRAGMAS:
        c.execute(f"PRAGMA {p}")
    return c


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rows_a_task: int = 1_000_000) -> DataFrame:
    """A table of a SQLite file that all tasks can open, in ranges of its row ids. schema: DDL, its names are the columns that are read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = ", ".join(f'"{n}"' for n in arrow.names)
    with _connect(path) as c:
        low, high = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
    starts = list(range(low, high + 1, rows_a_task))
    ranges = spark.range(0, len(starts), 1, max(1, len(starts))).select((F.col("id") * rows_a_task + low).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                found = _connect(path).execute(f'SELECT {names} FROM "{table}" WHERE rowid BETWEEN ? AND ?', (first, first + rows_a_task - 1))
                while rows := found.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

    return ranges.mapInArrow(run, schema)


def write_keyed(rows: DataFrame, path: str) -> None:
    """rows (key string, value binary, label) ordered by key, as a keyed store has them."""
    rows.select("key", F.col("value").cast("binary").alias("value"), "label").repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(path)


def read_keyed(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """All rows, or those of the keys; their ranges are in the files' statistics, so others are not read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("key").isin(*keys)) if keys else rows


def save_index(parts: dict[str, DataFrame], path: str, kind: str, **parameters) -> int:
    """The tables of an index as a new version of the folder; the version's number. A version can be loaded when its row of metadata is there, which comes last.

    A table may be stored in partitions by a column: give (table, column).
    """
    spark = next(iter(parts.values()))
    spark = (spark[0] if isinstance(spark, tuple) else spark).sparkSession
    version = len(versions(spark, path))
    for name, table in parts.items():
        table, by = table if isinstance(table, tuple) else (table, None)
        writer = table.repartition(by).write.partitionBy(by) if by else table.write
        writer.parquet(f"{path}/v{version}/{name}")
    meta = [(kind, version, json.dumps(parameters, sort_keys=True), sorted(parts))]
    spark.createDataFrame(meta, "kind string, version int, parameters string, parts array<string>").coalesce(1).write.mode("append").parquet(f"{path}/metadata")
    return version


def versions(spark: SparkSession, path: str) -> list:
    """The rows of metadata in order; none for a folder that is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return []
    return spark.read.parquet(f"{path}/metadata").orderBy("version").collect()  # a row a version


def load_index(spark: SparkSession, path: str, kind: str, version: int = -1) -> tuple[dict[str, DataFrame], dict]:
    """(tables, parameters) of a version, the last one unless it is given; another kind of index is an error."""
    rows = versions(spark, path)
    if not rows:
        raise FileNotFoundError(f"no index in {path}")
    row = rows[version]
    if row["kind"] != kind:
        raise ValueError(f"{path} is an index of kind {row['kind']}, not {kind}")
    return {p: spark.read.parquet(f"{path}/v{row['version']}/{p}") for p in row["parts"]}, json.loads(row["parameters"])
