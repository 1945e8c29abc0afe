"""Exact dedup by content sort, in DataFrame operations only.

Texts are equal if they are the same after white space is deleted. Sampled splitters
(repartitionByRange) range-partition the normalised bytes, an external sort puts equals
side by side, and the window's comparison of whole neighbouring texts ends each group.
Splitter keys are the first characters, a digest and a salt, so what is sampled to the
driver is small however long the texts are; the comparison is over whole texts.

Skew: digests of over 1/20,000 of all rows (fewer than 20,000 digests, so they can be
broadcast) are salted into parts of about that size; the parts' first rows, at most 40,000,
are compared by whole text again and merged.

Of equal texts the one with the most characters stays, then the smallest id (null last). Null
texts count as empty; rows that repeat an id are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm._common import materialize, partitions, text_of

WHITE = " \t\n\x0b\x0c\r"
HOT_SHARE, HOT_LEAST, SPLITTER_CHARS = 20_000, 64, 32


def normalised(text):
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sorted_groups(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Each row with the first row of its local group; whole: with the rows' own columns, as `row`, and only first rows."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), normalised(text).alias("norm"), *([F.struct("*").alias("row")] if whole else [])).withColumn("sha", F.sha2("norm", 256))
    most = max(HOT_LEAST, docs.count() // HOT_SHARE)
    hot = rows.groupBy("sha").count().where(F.col("count") > most).select("sha", F.ceil(F.col("count") / most).alias("parts"))
    salted = (
        rows.join(F.broadcast(hot), "sha", "left")  # fewer than HOT_SHARE rows
        .withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "chars"), F.col("parts"))).otherwise(F.lit(0).cast("long")))
        .withColumn("head", F.substring("norm", 1, SPLITTER_CHARS))
    )
    if whole:  # the text is shuffled once, within the row
        salted = salted.drop("norm")
    salted = salted.repartitionByRange(partitions(docs.sparkSession), "head", "sha", "salt")
    if whole:
        salted = salted.withColumn("norm", normalised(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))))
    same = W.partitionBy("head", "sha", "salt", "norm")
    first = same.orderBy(F.desc("chars"), F.asc_nulls_last("doc_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = salted.select(
        "doc_id", "sha", "salt", "parts",
        F.first("doc_id").over(first).alias("local_id"), F.first("chars").over(first).alias("local_chars"), F.row_number().over(first).alias("place"), F.count(F.lit(1)).over(same).alias("n"),
        "norm", *(["row"] if whole else []),
    ).withColumn("norm", F.when(F.col("parts").isNotNull() & (F.col("place") == 1), F.col("norm")))
    local = materialize(local.where("place = 1") if whole else local, "sorted")
    group = W.partitionBy("sha", "norm")
    ranked = group.orderBy(F.desc("local_chars"), F.asc_nulls_last("local_id"))
    merged = local.where("norm is not null").select(
        F.col("sha").alias("h_sha"), F.col("salt").alias("h_salt"), F.col("local_id").alias("h_id"),
        F.first("local_id").over(ranked.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("h_keep"), F.row_number().over(ranked).alias("h_place"), F.sum("n").over(group).alias("h_n"), F.lit(True).alias("h"),
    )
    return local.join(F.broadcast(merged), (F.col("sha") == F.col("h_sha")) & (F.col("salt") == F.col("h_salt")) & F.col("local_id").eqNullSafe(F.col("h_id")), "left")  # at most 2 * HOT_SHARE rows


#: The row that stays: the first of its local group, and that one the first of its merged group.
STAYS = "place = 1 and (h is null or h_place = 1)"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    out = sorted_groups(docs, id_col, text_col, False)
    keep = F.when(F.col("h"), F.col("h_keep")).otherwise(F.col("local_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("h_n", "n").alias("group_size"), F.expr(STAYS).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns."""
    return sorted_groups(docs, id_col, text_col, True).where(STAYS).select("row.*")
