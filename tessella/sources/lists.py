"""Lists in text files: paths, labels, pairs of images, and blocks of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.pairs import pair_id


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: the lines of text files that are not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_labels(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """path, label of lines `path label`; with a seed in an order drawn from it, which depends on the rows alone."""
    parts = read_lines(spark, path).select(F.regexp_extract("line", r"^(.*\S)\s+(-?\d+)$", 1).alias("path"), F.expr(r"try_cast(regexp_extract(line, '\\s(-?\\d+)$', 1) AS int)").alias("label")).where("path <> ''")
    return parts if seed is None else parts.orderBy(F.xxhash64(F.lit(seed), "path", "label"), "path", "label")


def read_pairs(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """id1, id2 of lines `name1 name2`: trimmed, blank lines and those with # first left out, as are unknown names; a pair comes once, whatever its order.

    images: id, name. Of a pair that is there in both orders, the one with the smaller first id is given.
    """
    lines = read_lines(spark, path).where("NOT startswith(line, '#')").select(F.split("line", " ").alias("p")).select(F.trim(F.get("p", F.lit(0))).alias("name1"), F.trim(F.get("p", F.lit(1))).alias("name2"))
    one, two = (images.select(F.col("id").alias(f"id{k}"), F.col("name").alias(f"name{k}")) for k in (1, 2))
    both = lines.join(one, "name1").join(two, "name2").withColumn("pair", pair_id(F.col("id1"), F.col("id2")))
    return both.groupBy("pair").agg(F.min(F.struct("id1", "id2")).alias("p")).select("p.*")


def read_match_blocks(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """id1, id2, idx1, idx2 of blocks: a line `name1 name2`, then lines `i j` up to a blank line.

    A block with an unknown name ends the reading of its file. Blocks are cut out of whole files, so a file is one task's work.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"[ \t]*\r?\n[ \t]*", "\n").alias("text"))
    blocks = text.select("file", F.posexplode(F.filter(F.split("text", r"\n{2,}|\A\n+"), lambda b: F.trim(b) != "")).alias("at", "block"))
    lines = blocks.select("file", "at", F.filter(F.split("block", "\n"), lambda x: x != "").alias("lines")).withColumn("names", F.split(F.get("lines", F.lit(0)), r"\s+"))
    one, two = (images.select(F.col("id").alias(f"id{k}"), F.col("name").alias(f"name{k}")) for k in (1, 2))
    known = lines.withColumn("name1", F.get("names", F.lit(0))).withColumn("name2", F.get("names", F.lit(1))).join(one, "name1", "left").join(two, "name2", "left")
    stop = known.where("id1 IS NULL OR id2 IS NULL").groupBy(F.col("file").alias("stop_file")).agg(F.min("at").alias("stop"))
    read = known.join(stop, F.col("file") == F.col("stop_file"), "left").where("stop IS NULL OR at < stop")
    rows = read.select("id1", "id2", F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")).select("id1", "id2", F.split("line", r"\s+").alias("m"))
    return rows.select("id1", "id2", F.get("m", F.lit(0)).cast("int").alias("idx1"), F.get("m", F.lit(1)).cast("int").alias("idx2"))
