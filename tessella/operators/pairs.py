"""Pair generators for matching, and the correspondence graph. A pair is (id1, id2), id1 < id2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.order import numbered
from tessella.sources.files import new_folder

PAIR_BASE = 2147483647


def pair_id(a: Column, b: Column) -> Column:
    """The order-free key of two ids."""
    return F.least(a, b) * PAIR_BASE + F.greatest(a, b)


def pair_decode(p: Column) -> tuple[Column, Column]:
    second = F.pmod(p, F.lit(PAIR_BASE))
    return ((p - second) / PAIR_BASE).cast("long"), second


def ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs without self-pairs."""
    return df.select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2")).where("id1 <> id2").distinct()


def exhaustive(images: DataFrame, key: str, blocks: int = 16) -> DataFrame:
    """Every unordered pair once. Ids are dealt over blocks by a hash, and each pair of blocks is one key of an equi-join, so no side is sent whole to a task."""
    ids = images.select(F.col(key).alias("id"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = ids.select("id", "block", F.explode(every).alias("other")).select(F.col("id").alias("a"), F.col("block").alias("i"), F.col("other").alias("j"))
    columns = ids.select("id", "block", F.explode(every).alias("other")).select(F.col("id").alias("b"), F.col("other").alias("i"), F.col("block").alias("j"))
    return rows.where("i <= j").join(columns.where("i <= j"), ["i", "j"]).where("i < j OR a < b").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"))


def undone(asked: DataFrame, matched: DataFrame, verified: DataFrame) -> DataFrame:
    """Asked pairs that lack matches or their verification: id1, id2, half_done (the matches are there)."""
    have = matched.select("id1", "id2").distinct().withColumn("m", F.lit(True))
    done = verified.select("id1", "id2").distinct().withColumn("v", F.lit(True))
    both = asked.select("id1", "id2").distinct().join(have, ["id1", "id2"], "left").join(done, ["id1", "id2"], "left")
    return both.where("m IS NULL OR v IS NULL").select("id1", "id2", F.coalesce("m", F.lit(False)).alias("half_done"))


def sequential(images: DataFrame, name: str, key: str, overlap: int = 10, quadratic: bool = True) -> DataFrame:
    """Neighbours in the order of names: offsets 1 to overlap - 1, and the powers of two while the plain offset is in range."""
    placed = numbered(images.select(F.col(key).alias("id"), F.col(name).alias("name")), "place", "name", "id").select("id", "place")
    last = placed.agg(F.max("place").alias("last"))
    offsets = F.sequence(F.lit(0), F.lit(overlap - 1))
    steps = F.concat(offsets, F.transform(offsets, lambda i: F.pow(F.lit(2), i).cast("int"))) if quadratic else offsets
    wanted = placed.crossJoin(F.broadcast(last)).withColumn("offset", F.explode(F.array_distinct(steps)))  # one row
    reach = F.when(F.col("offset") < overlap, F.col("offset")).otherwise(F.ceil(F.log2(F.greatest(F.col("offset"), F.lit(1)))))
    wanted = wanted.where((F.col("offset") > 0) & (F.col("place") + F.col("offset") <= F.col("last")) & (F.col("place") + reach <= F.col("last")))
    other = placed.select(F.col("id").alias("other"), F.col("place").alias("at"))
    return ordered(wanted.withColumn("at", F.col("place") + F.col("offset")).join(other, "at"), "id", "other")


def two_steps(pairs: DataFrame) -> DataFrame:
    """New pairs A-C of A-B and B-C."""
    both = pairs.select("id1", "id2").unionByName(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2")))
    met = both.alias("a").join(both.alias("b"), F.col("a.id2") == F.col("b.id1")).where("a.id1 < b.id2").select(F.col("a.id1").alias("id1"), F.col("b.id2").alias("id2"))
    return met.distinct().join(pairs.select("id1", "id2"), ["id1", "id2"], "left_anti")


def transitive(pairs: DataFrame, rounds: int = 3) -> DataFrame:
    """All proposed pairs of `rounds` rounds, each taken as verified; known pairs are left out."""
    known = ordered(pairs, "id1", "id2")
    spark, grown = pairs.sparkSession, known
    for _ in range(rounds):
        path = new_folder(spark, "pairs")
        grown.unionByName(two_steps(grown)).write.parquet(path)  # a round is read by the next one, not made again
        grown = spark.read.parquet(path)
    return grown.join(known, ["id1", "id2"], "left_anti")


def correspondences(matches: DataFrame, points: DataFrame) -> DataFrame:
    """Both directions of the matches that are kept: img, pt, img2, pt2.

    Left out: self-pairs, points out of range, and a match whose point on either side has an earlier one to the other
    image, earlier by (pt1, pt2). matches: id1, id2, pt1, pt2; points: id, n.
    """
    n1, n2 = points.select(F.col("id").alias("id1"), F.col("n").alias("n1")), points.select(F.col("id").alias("id2"), F.col("n").alias("n2"))
    m = matches.where("id1 <> id2").join(n1, "id1").join(n2, "id2").where("pt1 >= 0 AND pt2 >= 0 AND pt1 < n1 AND pt2 < n2").dropDuplicates(["id1", "id2", "pt1", "pt2"])
    first1 = F.row_number().over(W.partitionBy("id1", "id2", "pt1").orderBy("pt2"))
    first2 = F.row_number().over(W.partitionBy("id1", "id2", "pt2").orderBy("pt1"))
    m = m.withColumn("a", first1).where("a = 1").withColumn("b", first2).where("b = 1")
    return m.selectExpr("id1 AS img", "pt1 AS pt", "id2 AS img2", "pt2").unionByName(m.selectExpr("id2 AS img", "pt2 AS pt", "id1 AS img2", "pt1 AS pt2"))


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node: nodes within depth steps of each start, without it. edges: src, dst, both directions; starts: start."""
    seen = starts.select("start", F.col("start").alias("node"))
    front = seen
    for _ in range(depth):
        front = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("start <> node")


def two_view(edges: DataFrame) -> DataFrame:
    """Points with exactly one correspondence that has no other either. edges: both directions, img, pt, img2, pt2."""
    n = edges.groupBy("img", "pt").agg(F.count(F.lit(1)).alias("n"), F.first("img2").alias("img2"), F.first("pt2").alias("pt2")).where("n = 1")
    back = n.select(F.col("img").alias("b_img"), F.col("pt").alias("b_pt"))
    return n.join(back, (n["img2"] == back["b_img"]) & (n["pt2"] == back["b_pt"]), "left_semi").select("img", "pt")
