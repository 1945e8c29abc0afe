"""The feature store's tables as folders of Parquet with a schema file: made, described, extended, renamed and versioned without a catalogue service.

A table's schema is what its newest schema row says; files from before a column was added give null for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The tables of the store. Fixed values of the format.
TABLES = {
    "cameras": "camera_id int, model int, width int, height int, params binary, prior_focal_length boolean",
    "images": "image_id int, name string, camera_id int, prior_q array<double>, prior_t array<double>, scale double, offset double, registered boolean",
    "keypoints": "image_id int, rows int, cols int, data binary",
    "descriptors": "image_id int, rows int, cols int, data binary",
    "matches": "pair_id long, rows int, cols int, data binary",
    "two_view_geometries": "pair_id long, rows int, cols int, data binary, config int, f array<double>, e array<double>, h array<double>",
}
SCHEMAS = "name string, ddl string, folder string, number long"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _rows(spark: SparkSession, path: str) -> list:
    """The log of schemas in order; one row a change."""
    return spark.read.schema(SCHEMAS).parquet(f"{path}/_schemas").orderBy("number").collect() if _there(spark, f"{path}/_schemas") else []


def _log(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    first = len(_rows(spark, path))
    spark.createDataFrame([(*r, first + k) for k, r in enumerate(rows)], SCHEMAS).coalesce(1).write.mode("append").parquet(f"{path}/_schemas")


def schemas(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """name -> (DDL, folder) of the tables that there are; a row with an empty DDL takes a name away."""
    out: dict[str, tuple[str, str]] = {}
    for r in _rows(spark, path):
        if r["ddl"]:
            out[r["name"]] = (r["ddl"], r["folder"])
        else:
            out.pop(r["name"], None)
    return out


def create(spark: SparkSession, path: str, tables: dict[str, str] | None = None) -> None:
    """Tables that are not there yet."""
    have = schemas(spark, path)
    if new := [(name, ddl, name) for name, ddl in (TABLES if tables is None else tables).items() if name not in have]:
        _log(spark, path, new)


def append(rows: DataFrame, path: str, name: str) -> None:
    """Rows with some of the table's columns; another column or table is an error."""
    spark = rows.sparkSession
    ddl, folder = schemas(spark, path)[name]
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(ddl)}
    if extra := [c for c in rows.columns if c not in kinds]:
        raise ValueError(f"{name} has no column {extra[0]}")
    rows.select(*(rows[c].cast(kinds[c]).alias(c) for c in rows.columns)).write.mode("append").parquet(f"{path}/{folder}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    ddl, folder = schemas(spark, path)[name]
    if not _there(spark, f"{path}/{folder}"):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{path}/{folder}")


def add_column(spark: SparkSession, path: str, name: str, column: str) -> None:
    """column: DDL of one column; one that is there stays as it is."""
    ddl, folder = schemas(spark, path)[name]
    if column.split()[0] not in T.StructType.fromDDL(ddl).names:
        _log(spark, path, [(name, f"{ddl}, {column}", folder)])


def rename(spark: SparkSession, path: str, old: str, new: str) -> None:
    """The data stays where it is."""
    ddl, folder = schemas(spark, path)[old]
    _log(spark, path, [(new, ddl, folder), (old, "", folder)])


def exists(spark: SparkSession, path: str, name: str, column: str | None = None) -> bool:
    have = schemas(spark, path)
    return name in have and (column is None or column in T.StructType.fromDDL(have[name][0]).names)


def stamp(spark: SparkSession, path: str, number: int) -> None:
    spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/_version")


def version(spark: SparkSession, path: str) -> int:
    """The highest stamp; 0 for none."""
    return spark.read.parquet(f"{path}/_version").agg({"version": "max"}).first()[0] if _there(spark, f"{path}/_version") else 0


def described(spark: SparkSession, path: str) -> DataFrame:
    """name, n: the tables and how many columns they have."""
    return spark.createDataFrame([(name, len(T.StructType.fromDDL(ddl))) for name, (ddl, _) in schemas(spark, path).items()], "name string, n int")
