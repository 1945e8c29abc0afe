"""Streams: vectors that join an index as they come, and sequences that carry a state from frame to frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.indexes import InvertedLists


def insert_stream(vectors: DataFrame, path: str, checkpoint: str, index: InvertedLists | None = None):
    """A running query that appends the vectors of a stream to a folder; with an index, encoded into its lists.

    A batch is a folder of its own, named by its number, and is written over when it comes again: every vector is there once, whatever fails. Codebooks stay
    as they were trained.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch if index is None else index.encoded(batch, index.centres, index.books)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return vectors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inserted(spark: SparkSession, path: str, removed: DataFrame | None = None) -> DataFrame:
    """All vectors that have come, less those that are removed."""
    rows = spark.read.parquet(path).drop("batch")
    return rows if removed is None else rows.join(removed.select("id"), "id", "left_anti")


STATE = "n long, total double, last double"


def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per sequence: the number of each frame, the running sum of its values, and the change from the frame before, null for the first."""
    n, total, last = state.get if state.exists else (0, 0.0, None)
    rows = pd.concat(list(frames)).sort_values(["ts", "frame"])
    out = []
    for frame, value in zip(rows["frame"].tolist(), rows["value"].tolist(), strict=True):
        n, total = n + 1, total + value
        out.append((key[0], frame, n, total, None if last is None else value - last))
        last = value
    state.update((n, total, last))
    yield pd.DataFrame(out, columns=["sequence", "frame", "place", "total", "change"])


def sequences(frames: DataFrame) -> DataFrame:
    """frames (sequence, frame, ts, value), a stream in the order of ts from file to file -> sequence, frame, place, total, change."""
    schema = "sequence long, frame long, place long, total double, change double"
    return frames.groupBy("sequence").applyInPandasWithState(follow, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums of values by type in windows of a width; what comes later than `late` behind the newest is left out, and a window's state goes then."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
