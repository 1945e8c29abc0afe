"""Places and running sums over a whole table without gathering it in a task.

The rows are range-partitioned by the order, each range is numbered or summed by itself, and the counts or sums of
the ranges before, one row a range, are added. Give an order without ties: equal keys would share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.files import new_folder


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in ranges, `__range` the number of each row's; written to the shared folder, so that every pass sees the same ranges."""
    spark = df.sparkSession
    path = new_folder(spark, "ranges")
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def before(parts: DataFrame, total: Column) -> DataFrame:
    """__at, __before: of each range the total of those before it; a row a range."""
    sums = parts.groupBy(F.col("__range").alias("__at")).agg(total.alias("__n"))
    return sums.select("__at", (F.sum("__n").over(W.orderBy("__at")) - F.col("__n")).alias("__before"))


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with the place of each row in the order, from 1."""
    parts = ranged(df, *order)
    local = parts.withColumn(name, F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    joined = local.join(F.broadcast(before(parts, F.count(F.lit(1)))), F.col("__range") == F.col("__at"))  # a row a range
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__at", "__before")


def running(df: DataFrame, sums: dict[str, str], *order: str | Column) -> DataFrame:
    """df with running sums, own rows included. sums: new name -> column that is summed."""
    parts = ranged(df, *order)
    by = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = parts
    for name, column in sums.items():
        offsets = before(parts, F.sum(column)).select(F.col("__at").alias(f"__at_{name}"), F.col("__before").alias(f"__before_{name}"))
        out = out.withColumn(name, F.sum(column).over(by)).join(F.broadcast(offsets), F.col("__range") == F.col(f"__at_{name}"))  # a row a range
        out = out.withColumn(name, F.col(name) + F.coalesce(f"__before_{name}", F.lit(0))).drop(f"__at_{name}", f"__before_{name}")
    return out.drop("__range")
