"""Changes of a sparse model: points (point_id, x, y, z, error) and observations (point_id, image_id, idx), as rewritten tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_images(points: DataFrame, seen: DataFrame, images: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(points, observations) after images (image_id) are deregistered; points that are then seen in fewer than `least` images go too."""
    left = seen.join(images.select("image_id"), "image_id", "left_anti")
    kept = left.groupBy("point_id").agg(F.countDistinct("image_id").alias("n")).where(F.col("n") >= least).select("point_id")
    return points.join(kept, "point_id", "left_semi"), left.join(kept, "point_id", "left_semi")


def merged_points(points: DataFrame, seen: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each pair (point_id, into) is one point under `into`: its place is the mean weighted by track lengths, its track both tracks. A point is in one pair at most."""
    n = seen.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))
    named = points.join(pairs, "point_id", "left").withColumn("to", F.coalesce("into", "point_id")).join(n, "point_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = [(F.sum(F.col(c) * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias(c) for c in ("x", "y", "z", "error")]
    moved = seen.join(pairs, "point_id", "left").withColumn("point_id", F.coalesce("into", "point_id")).drop("into").distinct()
    return named.groupBy("to").agg(*mean).withColumnRenamed("to", "point_id"), moved


def cropped(points: DataFrame, seen: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Points of a box, its faces included, and what sees them."""
    inside = points.where(" AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("xyz", low, high, strict=True)))
    return inside, seen.join(inside.select("point_id"), "point_id", "left_semi")


def normalised(points: DataFrame, extent: float = 10.0) -> DataFrame:
    """Moved to their mean and scaled so that the largest side of their box is `extent`; one pass for the box."""
    box = points.agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("m", F.avg), ("a", F.min), ("b", F.max))))
    wide = F.greatest(*(F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"))
    scale = F.when(wide > 0, extent / F.when(wide > 0, wide).otherwise(1.0)).otherwise(1.0)
    return points.crossJoin(F.broadcast(box)).select("point_id", *((scale * (F.col(c) - F.col(f"m_{c}"))).alias(c) for c in "xyz"), "error")  # one row


def filtered(points: DataFrame, seen: DataFrame, most_error: float, least_track: int) -> DataFrame:
    """Points whose error and track length are good enough."""
    n = seen.groupBy("point_id").agg(F.countDistinct("image_id").alias("n"))
    return points.join(n, "point_id").where((F.col("error") <= most_error) & (F.col("n") >= least_track)).drop("n")


def unmasked(points: DataFrame, mask: DataFrame) -> DataFrame:
    """Keypoints (image_id, x, y) whose pixel is not one of the zero pixels of their image's mask (image_id, px, py)."""
    pixel = [F.floor(F.col(c)).cast("long").alias(f"__{c}") for c in ("x", "y")]
    own: list[Column] = [points[c] for c in points.columns]
    zero = mask.select(F.col("image_id").alias("__image"), F.col("px").cast("long").alias("__px"), F.col("py").cast("long").alias("__py"))
    placed = points.select(*own, *pixel)
    return placed.join(zero, (placed["image_id"] == zero["__image"]) & (placed["__x"] == zero["__px"]) & (placed["__y"] == zero["__py"]), "left_anti").drop("__x", "__y")
