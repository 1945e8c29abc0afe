"""Scalar and product quantisation, inverted files, PCA projection, VLAD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vectors as V


def min_max(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """dim, vmin, vdiff of each dimension, from 0."""
    parts = vectors.select(F.posexplode(V.doubles(F.col(embedding))).alias("dim", "x"))
    return parts.groupBy("dim").agg(F.min("x").alias("vmin"), (F.max("x") - F.min("x")).alias("vdiff"))


def sq_train(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: vmin and vdiff arrays over unit vectors."""
    m = min_max(vectors.select(V.l2norm(F.col(embedding)).alias("embedding")))
    s = m.agg(F.array_sort(F.collect_list(F.struct("dim", "vmin", "vdiff"))).alias("s"))  # a row per dimension
    return s.select(F.transform("s", lambda r: r["vmin"]).alias("vmin"), F.transform("s", lambda r: r["vdiff"]).alias("vdiff"))


def sq_encode(v: Column, vmin: Column, vdiff: Column) -> Column:
    """floor(255 x) of x = (v - vmin) / vdiff clamped to 0..1; 0 for vdiff 0."""
    x = F.zip_with(V.residual(v, vmin), vdiff, lambda a, d: F.when(d == 0, 0.0).otherwise(a / F.when(d == 0, 1.0).otherwise(d)))
    return F.transform(x, lambda t: F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))).cast("int"))


def sq_decode(code: Column, vmin: Column, vdiff: Column) -> Column:
    return F.zip_with(vmin, F.zip_with(vdiff, code, lambda d, c: d * (c + 0.5) / 255.0), lambda m, s: m + s)


def nearest_place(v: Column, centres: Column) -> Column:
    """The lowest place, from 0, of the centre with the least squared distance."""
    d = F.transform(centres, lambda c: V.l2sq(v, c))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def pq_code(r: Column, books: Column, m: int, width: int) -> Column:
    """The nearest sub-centre of each of m segments; books: an array of m arrays of sub-centres."""
    return F.array(*(nearest_place(V.segment(r, s, width), F.get(books, F.lit(s))) for s in range(m)))


def ivfpq_build(vectors: DataFrame, model: DataFrame, m: int, width: int) -> DataFrame:
    """id, list_id, code. model: one row of `centres` and `books`, a codebook of fixed size, broadcast."""
    x = vectors.crossJoin(F.broadcast(model)).withColumn("list_id", nearest_place(F.col("embedding"), F.col("centres")))  # one row
    return x.select("id", "list_id", pq_code(V.residual(F.col("embedding"), F.get("centres", F.col("list_id"))), F.col("books"), m, width).alias("code"))


def probes(queries: DataFrame, model: DataFrame, nprobe: int) -> DataFrame:
    """qid, list_id, residual of the nprobe nearest lists of each query."""
    x = queries.crossJoin(F.broadcast(model)).withColumn("d", F.transform("centres", lambda c, i: F.struct(V.l2sq(F.col("embedding"), c).alias("d"), i.alias("i"))))  # one row
    best = x.withColumn("p", F.explode(F.slice(F.array_sort("d"), 1, nprobe)))
    return best.select("qid", F.col("p.i").alias("list_id"), V.residual(F.col("embedding"), F.get("centres", F.col("p.i"))).alias("residual"), "books")


def adc_tables(probed: DataFrame, m: int, width: int) -> DataFrame:
    """The distance table of each query and list: an array of m arrays."""

    def row(s: int) -> Column:
        return F.transform(F.get("books", F.lit(s)), lambda c: V.l2sq(V.segment(F.col("residual"), s, width), c))

    return probed.select("qid", "list_id", F.array(*map(row, range(m))).alias("cells"))


def adc(code: Column, cells: Column) -> Column:
    return V.total(F.zip_with(code, cells, lambda c, row: F.get(row, c)))


def ivfpq_query(codes: DataFrame, queries: DataFrame, model: DataFrame, m: int, width: int, nprobe: int = 3) -> DataFrame:
    """qid, id, score of the entries in the probed lists."""
    tables = adc_tables(probes(queries, model, nprobe), m, width)
    return codes.join(tables, "list_id").select("qid", "id", adc(F.col("code"), F.col("cells")).alias("score"))


def pca_project(v: Column, mean: Column, axes: Column) -> Column:
    """(v - mean) by the axes, then unit length."""
    return V.l2norm(V.matmul(axes, V.residual(v, mean)))


def pca_back(y: Column, mean: Column, axes: Column) -> Column:
    """Back-projection of y before normalisation."""
    return F.transform(mean, lambda a, i: a + V.total(F.zip_with(y, axes, lambda w, axis: w * F.get(axis, i))))


def vlad(assigned: DataFrame, centres: DataFrame, signed_root: bool = False) -> DataFrame:
    """group, enc: residual sums per (cluster, dim) with a floor of 1e-12 on the norm. assigned: group, cluster, embedding; centres: cluster, centre."""
    parts = assigned.join(F.broadcast(centres), "cluster").select("group", "cluster", F.posexplode(V.residual(F.col("embedding"), F.col("centre"))).alias("dim", "r"))  # a codebook
    sums = parts.groupBy("group", "cluster", "dim").agg(F.sum("r").alias("r"))
    if signed_root:
        sums = sums.withColumn("r", F.signum("r") * F.sqrt(F.abs("r")))
    length = F.greatest(F.sqrt(F.sum(F.col("r") * F.col("r")).over(W.partitionBy("group"))), F.lit(1e-12))
    return sums.select("group", "cluster", "dim", (F.col("r") / length).alias("enc"))
