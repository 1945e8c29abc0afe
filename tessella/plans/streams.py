"""Streams over files made from the tables, and the tables' schema changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import catalog as C
from tessella.operators.indexes import InvertedLists
from tessella.plans import query, table
from tessella.sources.files import new_folder
from tessella.streaming import frames as S


def in_files(df, parts, number):
    """The rows as a folder of files, one for each number from 0; a stream reads them in the order of their names."""
    spark, at = df.sparkSession, new_folder(df.sparkSession, "stream")
    for n in range(parts):
        df.where(number == n).coalesce(1).write.parquet(f"{at}/part={n}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")


@query("stream_insert", "SELECT vec_id AS id, list_transform(embedding, lambda v: round(v::DOUBLE, 6) + 0.0) AS embedding FROM embeddings WHERE vec_id % 11 <> 5")
def stream_insert(spark, sf_dir):
    """Vectors come in four files and join the table; some are removed afterwards."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = new_folder(spark, "inserted")
    S.insert_stream(in_files(e, 4, F.col("id") % 4), path, new_folder(spark, "checkpoint")).awaitTermination()
    return S.inserted(spark, path, e.where("id % 11 = 5")).select("id", F.transform("embedding", lambda v: F.round(v.cast("double"), 6) + 0.0).alias("embedding"))


@query("stream_index", "SELECT vec_id AS id, TRUE AS has_list, 4 AS code_length FROM embeddings")
def stream_index(spark, sf_dir):
    """Vectors come in three files and are encoded by an index trained on the first of them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = InvertedLists.build(e.where("id % 3 = 0"), 4, 4, 4, 2)
    path = new_folder(spark, "inserted")
    S.insert_stream(in_files(e, 3, F.col("id") % 3), path, new_folder(spark, "checkpoint"), index).awaitTermination()
    return S.inserted(spark, path).select("id", F.col("list_id").between(0, 3).alias("has_list"), F.size("code").alias("code_length"))


@query("stream_frames", "SELECT user_id AS sequence, event_id AS frame, row_number() OVER w AS place, round(sum(value) OVER w, 4) + 0.0 AS total, round(value - lag(value) OVER w, 4) + 0.0 AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def stream_frames(spark, sf_dir):
    """Events of a user as the frames of a sequence, in three files by time."""
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("sequence"), F.col("event_id").alias("frame"), F.col("ts").cast("timestamp").alias("ts"), "value")
    low, high = x.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = F.least(F.floor((F.unix_micros("ts") - low) * 3 / max(high - low, 1)), F.lit(2)) if low is not None else F.lit(0)
    at = new_folder(spark, "sequences")
    out = S.sequences(in_files(x, 3, third))
    out.writeStream.format("parquet").option("path", at).option("checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at).select("sequence", "frame", "place", (F.round("total", 4) + 0.0).alias("total"), (F.round("change", 4) + 0.0).alias("change"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Days of events; the bound for late ones is wider than the table, so none is left out."""
    x = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    at = new_folder(spark, "windows")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(at)  # the whole state as it is; the last batch is the result

    S.windowed(in_files(x, 3, F.col("event_id") % 3), "1 day", "36500 days").writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ddl_create", "SELECT t AS name, n FROM (VALUES ('cameras', 6), ('images', 8), ('keypoints', 4), ('descriptors', 4), ('matches', 4), ('two_view_geometries', 8)) v(t, n)")
def ddl_create(spark, sf_dir):
    """The store's tables, made twice: the second time changes nothing."""
    path = new_folder(spark, "store")
    C.create(spark, path)
    C.create(spark, path)
    return C.described(spark, path)


@query("ddl_evolve", "SELECT n_nationkey AS image_id, n_name AS name, NULL::INT AS exif_model, 2 AS version FROM nation")
def ddl_evolve(spark, sf_dir):
    """Rows from before a column was added have null there; the store's version is stamped."""
    path = new_folder(spark, "store")
    C.create(spark, path)
    C.append(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS image_id", "n_name AS name"), path, "images")
    C.add_column(spark, path, "images", "exif_model int")
    C.stamp(spark, path, 2)
    return C.read(spark, path, "images").select("image_id", "name", "exif_model", F.lit(C.version(spark, path)).alias("version"))


@query("ddl_rename", "SELECT n_nationkey AS image_id, TRUE AS new_there, FALSE AS old_there FROM nation")
def ddl_rename(spark, sf_dir):
    """A table under its old name is found under the new one."""
    path = new_folder(spark, "store")
    C.create(spark, path)
    C.append(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS image_id"), path, "images")
    C.rename(spark, path, "images", "views")
    return C.read(spark, path, "views").select("image_id", F.lit(C.exists(spark, path, "views")).alias("new_there"), F.lit(C.exists(spark, path, "images")).alias("old_there"))


@query("ddl_exists", "SELECT * FROM (VALUES ('images', NULL, TRUE), ('images', 'name', TRUE), ('images', 'colour', FALSE), ('nothing', NULL, FALSE)) t(name, field, there)")
def ddl_exists(spark, sf_dir):
    path = new_folder(spark, "store")
    C.create(spark, path)
    asked = [("images", None), ("images", "name"), ("images", "colour"), ("nothing", None)]
    return spark.createDataFrame([(t, c, C.exists(spark, path, t, c)) for t, c in asked], "name string, field string, there boolean")
