"""Ranking metrics and robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.order import running


def nearest_rank(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """key, value at place round(p / 100 (n - 1)) of each group in order; by numbering rows, so no group is gathered."""
    by = W.partitionBy(key)
    numbered = df.where(F.col(value).isNotNull()).select(key, value, F.row_number().over(by.orderBy(value)).alias("rn"), F.count(F.lit(1)).over(by).alias("n"))
    return numbered.where(F.col("rn") - 1 == F.round(p / 100 * (F.col("n") - 1))).select(key, value)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the ROC curve by trapezoids over equal scores; null for one class. Counts by score come first, so the running sum is over distinct scores, range by range."""
    c = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    area = running(c, {"tp": "p"}, F.desc("s")).agg(F.sum((2 * F.col("tp") - F.col("p")) * F.col("n") / 2).alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return area.select(F.try_divide("a", F.col("p") * F.col("n")).alias("auc"))


def trimmed(df: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    """One row: lower and upper bound of an axis between two shares of its sorted values, and the mean between them."""
    n = df.agg(F.count(axis).alias("n"))
    v = df.where(F.col(axis).isNotNull()).groupBy(F.col(axis).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    v = running(v, {"to": "k"}, F.col("v")).crossJoin(F.broadcast(n))  # one row
    first, last = F.floor(low * (F.col("n") - 1)), F.floor(high * (F.col("n") - 1))
    inside = F.greatest(F.lit(0), F.least(F.col("to") - 1, last) - F.greatest(F.col("to") - F.col("k"), first) + 1)
    kept = v.withColumn("use", inside).where("use > 0")
    return kept.agg(F.min("v").alias("lower"), F.max("v").alias("upper"), (F.sum(F.col("v") * F.col("use")) / F.sum("use")).alias("centre"))


def trial_count(inlier_ratio: Column, sample: int, confidence: float = 0.99, multiplier: float = 3.0) -> Column:
    """ceil(log(1 - confidence) / log(1 - r^m) multiplier); 1 for r = 1, the largest long for r = 0."""
    bad = 1 - F.pow(inlier_ratio, F.lit(float(sample)))
    n = F.ceil(F.ln(F.lit(1 - confidence)) / F.ln(F.when((bad > 0) & (bad < 1), bad).otherwise(0.5)) * multiplier)
    return F.when(bad <= 0, F.lit(1)).when(bad >= 1, F.lit(9223372036854775807)).otherwise(n)
