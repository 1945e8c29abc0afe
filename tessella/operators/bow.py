"""Visual words: Hamming embedding, postings, idf, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators.scores import Worded


def assign(descriptors: DataFrame, words: DataFrame, n: int = 1) -> DataFrame:
    """The n nearest words of each descriptor: its columns and word_id. words: word_id, centre; a vocabulary, gathered into one row and broadcast."""
    book = words.agg(F.array_sort(F.collect_list(F.struct("word_id", V.doubles(F.col("centre")).alias("c")))).alias("book"))
    d = F.transform("book", lambda w: F.struct(V.l2sq(F.col("embedding"), w["c"]).alias("d"), w["word_id"].alias("w")))
    return descriptors.crossJoin(F.broadcast(book)).withColumn("word_id", F.explode(F.transform(F.slice(F.array_sort(d), 1, n), lambda p: p["w"]))).drop("book")  # one row


def thresholds(assigned: DataFrame, bits: int, least: int = 5) -> DataFrame:
    """word_id, t: the median of each of the first dimensions over a word's descriptors; words with fewer than `least` are left out."""
    parts = assigned.select("word_id", F.posexplode(F.slice(V.doubles(F.col("embedding")), 1, bits)).alias("dim", "x"))
    m = parts.groupBy("word_id", "dim").agg(F.expr("percentile(x, 0.5)").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return m.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("dim", "t"))).alias("s")).select("word_id", F.transform("s", lambda r: r["t"]).alias("t"))  # `bits` rows a word


def signatures(assigned: DataFrame, trained: DataFrame, bits: int) -> DataFrame:
    """assigned with sig, null for words without thresholds."""
    return assigned.join(trained, "word_id", "left").withColumn("sig", V.threshold_bits(F.slice("embedding", 1, bits), F.col("t"))).drop("t")


def idf(postings: DataFrame) -> DataFrame:
    """word_id, idf: ln of images over images that contain the word."""
    seen = postings.select("word_id", "image_id").distinct()
    n = seen.agg(F.countDistinct("image_id").alias("n_images"))
    return seen.groupBy("word_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("word_id", F.ln(F.col("n_images") / F.col("n")).alias("idf"))  # one row


def norms(postings: DataFrame, weights: DataFrame, key: str, empty: float) -> DataFrame:
    """key, norm: one over the root of the sum of squared idf; `empty` where the sum is 0."""
    s = postings.join(weights, "word_id").groupBy(key).agg(F.sum(F.col("idf") * F.col("idf")).alias("s"))
    return s.select(key, F.when(F.col("s") > 0, 1 / F.sqrt("s")).otherwise(empty).alias("norm"))


def scored(queries: DataFrame, postings: DataFrame) -> Worded:
    """Scores of images by queries, normalised on both sides. queries: query, feature_id, word_id, sig; postings: word_id, image_id, feature_id, sig."""
    weights = idf(postings)
    return Worded(postings, queries.join(norms(queries, weights, "query", 1.0), "query"), {r["word_id"]: r["idf"] for r in weights.collect()})  # a vocabulary
