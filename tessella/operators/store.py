"""The relational feature store: insert, update, delete, clear and merge on DataFrames, and checks of its constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.pairs import pair_id


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Appended; columns that one side lacks are null."""
    return df.unionByName(rows, allowMissingColumns=True)


def update(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of df replaced by those of equal key; keys that df lacks are left out."""
    return df.join(rows.select(key), key, "left_anti").unionByName(rows.join(df.select(key), key, "left_semi"))


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def clear(df: DataFrame) -> DataFrame:
    """The table without its rows."""
    return df.limit(0)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness."""
    return df.groupBy(key).count().where("count > 1")


def orphans(df: DataFrame, foreign: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key has no parent."""
    return df.join(parents.select(F.col(key).alias("__key")), F.col(foreign) == F.col("__key"), "left_anti").where(F.col(foreign).isNotNull())


def merge(images1: DataFrame, images2: DataFrame) -> DataFrame:
    """Two image tables (image_id, name, camera_id) as one: ids of the second follow those of the first. A name in both is an error when the result is read."""
    top = images1.agg(F.coalesce(F.max("image_id") + 1, F.lit(0)).alias("i"), F.coalesce(F.max("camera_id") + 1, F.lit(0)).alias("c"))
    moved = images2.crossJoin(F.broadcast(top)).select((F.col("image_id") + F.col("i")).alias("image_id"), "name", (F.col("camera_id") + F.col("c")).alias("camera_id"))  # one row
    clash = images1.select(F.col("name").alias("__name")).distinct()
    checked = moved.join(clash, moved["name"] == clash["__name"], "left").withColumn("name", F.when(F.col("__name").isNull(), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("name in both: "), F.col("name"))))).drop("__name")
    return images1.select("image_id", "name", "camera_id").unionByName(checked)


def with_pair(df: DataFrame, id1: str, id2: str, idx1: str, idx2: str) -> DataFrame:
    """Matches in normal order: pair_id, and the indices swapped where the ids are."""
    swap = F.col(id1) > F.col(id2)
    return df.withColumn("pair_id", pair_id(F.col(id1), F.col(id2))).withColumn("a", F.when(swap, F.col(idx2)).otherwise(F.col(idx1))).withColumn("b", F.when(swap, F.col(idx1)).otherwise(F.col(idx2)))
