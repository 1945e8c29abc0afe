"""Connected components of an edge table: contraction within tasks, then alternating large and small stars.

A task reads its edges in blocks of at most BLOCK, replaces each block by stars (every node with the smallest node that it
reaches within the block), and goes on with these and the next edges. Where all edges are one block at most, that is the
result. Otherwise rounds of stars follow, each of group minima and joins, with a contraction after each; their number grows
with the logarithm of the longest path. Nothing is gathered to the driver but two sums a round.

A hub, a node with a large share of all edges, meets its minimum without a shuffle: minima are
combined before they are shuffled, and those of hubs (fewer than HOT_SHARE rows) are broadcast
to the edges, which stay where they are. Only edges of other nodes are dealt by node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import hot_rows, materialize

#: Edges that a task holds at once.
BLOCK = 500_000


def with_least(pairs: DataFrame, most: int) -> DataFrame:
    """pairs (u, v) with m, the least v of u; u with over `most` rows get theirs by broadcast."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = low.where(F.col("n") > most).select("u", F.col("m").alias("hub_m"))  # fewer than all pairs / most
    marked = pairs.join(F.broadcast(hubs), "u", "left")
    others = marked.where("hub_m is null").select("u", "v").join(low.where(F.col("n") <= most).select("u", "m"), "u")
    return marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(others.select("u", "v", "m"))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of edges: every node but the roots, with the smallest node that it reaches."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code.ravel()[: len(u)], code.ravel()[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def contracted(edges: DataFrame, tasks: int, block: int) -> DataFrame:
    """Edges (u, v), u > v, that connect what the given ones do: the stars of blocks. Tasks are put together, not shuffled."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held, like = [], [], 0, None

        def put(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u, like), pa.array(v, like)], names=["u", "v"])

        for batch in batches:
            like = batch.schema.field(0).type
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                us.append(part.column(0).to_numpy(zero_copy_only=False))
                vs.append(part.column(1).to_numpy(zero_copy_only=False))
                held += part.num_rows
                if held >= block:
                    u, v = stars(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
                    if held > block // 2:
                        yield put(u, v)
                        us, vs, held = [], [], 0
        if held:
            yield put(*stars(np.concatenate(us), np.concatenate(vs)))

    return edges.coalesce(tasks).mapInArrow(run, f"u {kind}, v {kind}")


def components(edges: DataFrame, most_rounds: int = 40, block: int = BLOCK) -> DataFrame:
    """edges (u, v) of one comparable type -> (node, root), root the smallest node reachable; nodes without an edge are left out."""

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges.where("u <> v").select("u", "v"), "edges")
    n = e.count()
    e = materialize(contracted(e, max(1, -(-n // block)), block), "edges")
    if n > block:
        last = stamp(e)
        for _ in range(most_rounds):
            most = hot_rows(2 * last[0])
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = with_least(both, most).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
            large = materialize(large, "large")
            small = with_least(large, most).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            e = materialize(small.where("u <> v").distinct(), "edges")
            if (now := stamp(e)) == last:
                break
            last = now
        else:
            raise RuntimeError(f"components: no end after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
