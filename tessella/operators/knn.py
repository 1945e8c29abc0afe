"""Exact search: k nearest and radius.

The queries are a stated set against all rows. They are sent to the tasks in blocks of at most
BLOCK_BYTES, each block a pass over the database; a task multiplies a batch by a block and emits
the batch's k best of each query, which a window merges. Neither side is shuffled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20
SCHEMA = "qid long, id long, dist double"


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


#: Metrics of a batch and one query; the same as the Column functions of these names.
COLUMNWISE = {
    "l1": lambda x, v: np.abs(x - v).sum(1),
    "linf": lambda x, v: np.abs(x - v).max(1),
    "hellinger": lambda x, v: ((np.sqrt(x) - np.sqrt(v)) ** 2).sum(1),
    "chi2": lambda x, v: np.divide((x - v) ** 2, x + v, out=np.zeros(x.shape), where=x + v > 0).sum(1),
}


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return 1 - q @ x.T
    if metric == "l2sq":  # by differences: exact zero for equal vectors
        return np.stack([((x - v) ** 2).sum(1) for v in q]) if len(x) else np.empty((len(q), 0))
    if metric in COLUMNWISE:
        return np.stack([COLUMNWISE[metric](x, v) for v in q]) if len(x) else np.empty((len(q), 0))
    if metric == "dot":
        return q @ x.T
    raise ValueError(metric)


def rough_squares(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by products, and how far they may be off."""
    a, b = (q * q).sum(1), (x * x).sum(1)
    return a[:, None] + b - 2 * (q @ x.T), 1e-13 * float(a.max(initial=0) + b.max(initial=0)) * (8 + q.shape[1])


def picked(q: np.ndarray, x: np.ndarray, pick, metric: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(places, their distances) of each query. Squared distances by differences are made only where those by products may be picked."""
    if metric != "l2sq" or not np.isfinite(x).all() or not np.isfinite(q).all():
        d = distances(q, x, metric)
        places = [pick(row, 0.0) for row in d]
        return places, [row[p] for row, p in zip(d, places, strict=True)]
    rough, off = rough_squares(q, x)
    out: tuple[list, list] = ([], [])
    for row, v in zip(rough, q, strict=True):
        near = pick(row, 2 * off)
        d = ((x[near] - v) ** 2).sum(1)
        exact = pick(d, 0.0)
        out[0].append(near[exact])
        out[1].append(d[exact])
    return out


def blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows, size = [], [], 0
    for r in queries.select("qid", "embedding").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        size += 8 * len(r[1])
        if size >= BLOCK_BYTES:
            yield np.array(ids), np.array(rows, float)
            ids, rows, size = [], [], 0
    yield np.array(ids, np.int64), np.array(rows, float)


def searched(db: DataFrame, queries: DataFrame, pick, metric: str) -> DataFrame:
    """pick: (a row of distances, how far they may be off) -> places of the batch to emit."""

    def one(block: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        sent = db.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                for at in range(0, len(ids), 256):
                    places, near = picked(q[at : at + 256], x, pick, metric)
                    counts = [len(p) for p in places]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 256], counts)), pa.array(own[np.concatenate(places)]), pa.array(np.concatenate(near))], names=["qid", "id", "dist"])

        return db.select("id", "embedding").mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(one, blocks(queries)))


def top_k(found: DataFrame, k: int, *order) -> DataFrame:
    """The k best of each query with their rank; ties by id."""
    by = W.partitionBy("qid").orderBy(*(order or (F.round("dist", 9), "id")))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def knn(db: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """db (id, embedding), queries (qid, embedding) -> qid, id, dist, rank; min(k, n) rows a query."""

    def pick(row: np.ndarray, slack: float) -> np.ndarray:
        if len(row) <= k:
            return np.arange(len(row))
        return np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 1e-9 + slack)  # ties stay for the merge

    return top_k(searched(db, queries, pick, metric), k)


def radius(db: DataFrame, queries: DataFrame, r: float, metric: str = "l2sq", most: int = -1) -> DataFrame:
    """qid, id, dist of all pairs under r, at most `most` a query if that is not negative."""
    found = searched(db, queries, lambda row, slack: np.flatnonzero(row < r + slack), metric)
    return found if most < 0 else top_k(found, most).drop("rank")


def farthest(db: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """The k rows of largest distance of each query, by falling distance; a task emits its k largest only."""

    def pick(row: np.ndarray, slack: float) -> np.ndarray:
        return np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9 - slack)

    return top_k(searched(db, queries, pick, metric), k, F.round("dist", 9).desc(), "id")


def grid_radius(points: DataFrame, queries: DataFrame, r: float, dims: int) -> DataFrame:
    """qid, id, dist (squared) of points (id, x) nearer than r to queries (qid, x), in few dimensions.

    Cells of a grid are r wide; a query goes to its own cell and all around it, and both sides are dealt by cell.
    """

    def cell(shifts: list) -> list:
        return [(F.floor(F.get("x", F.lit(d)) / r) + s).cast("long").alias(f"c{d}") for d, s in enumerate(shifts)]

    own = points.select("id", F.col("x").alias("p"), *cell([0] * dims))
    around = queries
    for d in range(dims):
        around = around.withColumn(f"s{d}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    around = around.select("qid", F.col("x").alias("q"), *cell([F.col(f"s{d}") for d in range(dims)]))
    dist = F.aggregate(F.zip_with("p", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return own.join(around, [f"c{d}" for d in range(dims)]).select("qid", "id", dist.alias("dist")).where(F.col("dist") < r * r)


def grid_nearest(points: DataFrame, queries: DataFrame, k: int, r: float, dims: int, digits: int = 9, levels: int = 12) -> DataFrame:
    """qid, id, dist (squared), rank of the k nearest points (id, x) within r of each query (qid, x), in few dimensions; distances that round to the same digits are ties, by id.

    Of points at the same place only the k smallest ids can be among the nearest, and queries at the same place have the same ones, so places are compared. A place of a
    query looks into the finest grid, of cells r / 3^n wide, in whose cell it has k points: the k nearest are then within the cell's diagonal, and the grid that is searched has
    cells that wide. Where no cell has k points, cells are r wide. Both sides are dealt by cell.
    """
    at = [f"x{d}" for d in range(dims)]
    apart = [F.get("x", F.lit(d)).cast("double").alias(c) for d, c in enumerate(at)]
    own = points.select("id", *apart).withColumn("n", F.row_number().over(W.partitionBy(*at).orderBy("id"))).where(F.col("n") <= k).drop("n")
    asked = queries.select("qid", *apart)
    widths = [r / 3.0**n for n in range(1, levels)]
    reach = [r * (1 + 1e-9) + 1e-9] + [w * dims**0.5 * (1 + 1e-9) + 1e-3 for w in widths]  # of the searched grids; the first is for the rest

    def cell(width: Column, shifts: list) -> list[Column]:
        return [(F.floor(F.col(c) / width) + s).cast("long").alias(f"c{d}") for d, (c, s) in enumerate(zip(at, shifts, strict=True))]

    def leveled(df: DataFrame, sizes: list[float], first: int) -> DataFrame:
        return df.withColumn("l", F.explode(F.array(*(F.struct(F.lit(first + n).alias("level"), F.lit(w).alias("width")) for n, w in enumerate(sizes))))).select(*df.columns, "l.level", "l.width")

    cells = ["level", *(f"c{d}" for d in range(dims))]
    still = [F.lit(0)] * dims
    places = asked.select(*at).distinct()
    full = leveled(own, widths, 1).select("level", *cell(F.col("width"), still)).groupBy(*cells).count().where(F.col("count") >= k)
    deepest = leveled(places, widths, 1).select(*at, "level", *cell(F.col("width"), still)).join(full, cells).groupBy(*at).agg(F.max("level").alias("level"))
    around = places.join(deepest, at, "left").withColumn("level", F.coalesce("level", F.lit(0))).withColumn("width", F.get(F.array(*map(F.lit, reach)), F.col("level")))
    for d in range(dims):
        around = around.withColumn(f"s{d}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    around = around.select(*(F.col(c).alias(f"q_{c}") for c in at), "level", *cell(F.col("width"), [F.col(f"s{d}") for d in range(dims)]))
    held = leveled(own, reach, 0).select("id", *at, "level", *cell(F.col("width"), still))
    squares = [(F.col(c) - F.col(f"q_{c}")) * (F.col(c) - F.col(f"q_{c}")) for c in at]
    met = held.join(around, cells).select(*(f"q_{c}" for c in at), "id", reduce(Column.__add__, squares).alias("dist")).where(F.col("dist") <= r * r)
    by = W.partitionBy(*(f"q_{c}" for c in at)).orderBy(F.round("dist", digits), "id")
    best = met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return asked.join(best, [F.col(c) == F.col(f"q_{c}") for c in at]).select("qid", "id", "dist", "rank")
