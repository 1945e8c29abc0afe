"""Helpers shared by the training-data operators: shared storage and schemas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the master is local (tests on one machine) a temporary folder is made; on a
    cluster a folder of one machine would be lost with it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        base = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage is cut, an executor's loss costs nothing."""
    spark = df.sparkSession
    path = step_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that this process has written steps to, by application.
_WRITTEN: dict[str, list[str]] = {}


def step_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the steps that this application has written, when the results that read them are no longer needed; how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


#: A key is hot if it has over 1 / HOT_SHARE of all rows, so fewer than HOT_SHARE keys are; small tables have none.
HOT_SHARE, HOT_LEAST = 20_000, 64


def hot_rows(rows: int) -> int:
    """The number of rows over which a key of a table of this size is hot."""
    return max(HOT_LEAST, rows // HOT_SHARE)


def join_one(many: DataFrame, one: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """many joined with one, which has a row a key at most; rows whose key is not in one are left out.

    Rows of hot keys stay where they are: what they join, fewer than HOT_SHARE rows, is broadcast. keys: a table that
    has the key of each row of many and is cheap to read, if many is not.
    """
    keys = (many if keys is None else keys).select(key)
    hot = materialize(keys.groupBy(key).count().where(F.col("count") > hot_rows(keys.count())).select(key), "hot-keys")
    if hot.isEmpty():
        return many.join(one, key)
    few = F.broadcast(one.join(F.broadcast(hot), key, "left_semi"))
    return many.join(few, key).unionByName(many.join(F.broadcast(hot), key, "left_anti").join(one, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """The schema entry of a column that is passed through unchanged."""
    return T.StructField(name or column, df.schema[column].dataType, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str):
    """The text, an empty string for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sampled(df: DataFrame, n: int, id_col: str, *columns: str) -> DataFrame:
    """The rows whose id has one of the n smallest hashes, one for each id: a bounded sample of df.

    Two passes: the first sorts hashes only, of which four times as many as are needed come from a filter;
    the second reads the columns of the chosen rows, which stay spread over the tasks.
    """
    total = df.count()
    low = -(1 << 63) + min((1 << 64) - 1, ((4 * n) << 64) // max(total, 1))
    few = df.withColumn("__h", F.xxhash64(id_col)).where(F.col("__h") <= low)
    last = few.select("__h").distinct().orderBy("__h").limit(n).agg(F.max("__h")).first()[0]
    chosen = few.where(F.col("__h") <= (low if last is None else last)).select("__h", *columns)
    row = F.min(F.struct(*columns)).alias("row")
    return chosen.repartition(partitions(df.sparkSession), "__h").groupBy("__h").agg(row).select("row.*")


def sampled_each(df: DataFrame, n: int, id_col: str, by: str, *columns: str) -> DataFrame:
    """Like sampled(), for each value of by: the rows whose id has one of the n smallest hashes of that value's rows.

    The hashes that are sorted are about 4 n for each value, the broadcast tables have a row for each value.
    """
    low = F.least(F.lit(float(1 << 63)), F.lit(-float(1 << 63)) + F.lit(4.0 * n * (1 << 64)) / F.count(F.lit(1))).alias("__low")
    lows = df.groupBy(F.col(by).alias("__by")).agg(low)
    few = df.withColumn("__h", F.xxhash64(id_col)).join(F.broadcast(lows), F.col(by) == F.col("__by")).where(F.col("__h").cast("double") <= F.col("__low")).drop("__low")
    place = F.row_number().over(Window.partitionBy("__by").orderBy("__h"))
    lasts = few.select("__by", "__h").distinct().withColumn("__place", place).where(F.col("__place") <= n).groupBy(F.col("__by").alias("__of")).agg(F.max("__h").alias("__last"))
    chosen = few.join(F.broadcast(lasts), F.col("__by") == F.col("__of")).where(F.col("__h") <= F.col("__last")).select("__by", "__h", *columns)
    row = F.min(F.struct(*columns)).alias("row")
    return chosen.repartition(partitions(df.sparkSession), "__by", "__h").groupBy("__by", "__h").agg(row).select("row.*")
