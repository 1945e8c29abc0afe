"""Benchmark decontamination by size-partitioned MinHash containment search.

A document contains an item if it has at least `least` (0.8) of the item's distinct shingles of
five words. Items are partitioned by size, n shingles, at powers of two. An item's sketch is its
smallest MinHash values: of n shingles at most m = n - ceil(least n) can be missing, so of the
m + 1 smallest hashes a document that contains the item has at least one. A document is held
only against the partitions whose items it is long enough to contain, and there against sketches
of about one size, however long it is itself. Nothing is lost, whatever the ratio of sizes.
What a sketch finds is verified by exact shingles.

Words are runs of letters and digits, in lower case. Fewer words than five are one shingle.
Items without a word are never found.

The items are a stated query set against all documents. Their sketches and shingles go to the
tasks in blocks of at most `block_shingles` shingles, each block a pass over the documents, so
what is sent has a bound. No shuffle; a task holds one document at a time. Null texts are
empty; repeated documents and items are reported each; null ids are kept; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm._common import field, slices, text_of

WORD = regex.compile(r"[\p{L}\p{N}]+")


def shingles(text: str, words: int = 5) -> list[str]:
    w = WORD.findall(text.lower())
    return list(map(" ".join, zip(*(w[i:] for i in range(words)), strict=False))) if len(w) >= words else [" ".join(w)] if w else []


class SizePartition:
    """Items of n to 2n - 1 shingles: the least number that one of them needs, and their sketches by hash."""

    def __init__(self) -> None:
        self.least, self.sketches = math.inf, defaultdict(list)

    def add(self, item: int, hashes: list[int], need: int) -> None:
        self.least = min(self.least, need)
        for h in hashes[: len(hashes) - need + 1]:
            self.sketches[h].append(item)


class Items:
    """A block of items by size, with their shingles for the verification."""

    def __init__(self, rows: list[tuple], least: float, words: int):
        self.words, self.held, self.need = words, [], []
        parts: dict[int, SizePartition] = defaultdict(SizePartition)
        for k, (_, text) in enumerate(rows):
            own = set(shingles(text or "", words))
            self.held.append(own)
            self.need.append(math.ceil(least * len(own) - 1e-9))
            if own:
                parts[len(own).bit_length()].add(k, sorted(map(xxhash.xxh64_intdigest, own)), self.need[k])
        self.parts = [p for _, p in sorted(parts.items())]

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(item's place, shared shingles) of the items that the text contains."""
        own = shingles(text, self.words)
        hashes = set(map(xxhash.xxh64_intdigest, own))
        met = {k for p in self.parts if p.least <= len(hashes) for h in p.sketches.keys() & hashes for k in p.sketches[h]}
        if met:
            own = set(own)
            for k in sorted(met):
                if (shared := len(self.held[k] & own)) >= self.need[k]:
                    yield k, shared


def contained(docs: DataFrame, items: DataFrame, least: float = 0.8, words: int = 5, block_shingles: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for each pair of a document and an item that it contains."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = T.StructType([field(docs, id_col, "doc_id"), field(items, item_col, "item_id"), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("containment", T.DoubleType())])

    def search(rows: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(rows)  # at most block_shingles shingles

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, names = Items(sent.value, least, words), [r[0] for r in sent.value]
            for batch in slices(batches):
                like, out = batch.schema.field(0).type, []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out += [(doc, names[k], shared, len(block.held[k]), shared / len(block.held[k])) for k, shared in block.find(text)]
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (like, item_type, pa.int64(), pa.int64(), pa.float64()), strict=True)], names=[f.name for f in schema])

        return source.mapInArrow(run, schema)

    item_type = to_arrow_type(items.schema[item_col].dataType)
    return reduce(DataFrame.unionByName, map(search, item_blocks(items, block_shingles, item_col, item_text_col)))


def item_blocks(items: DataFrame, block_shingles: int, item_col: str, item_text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one at least."""
    block, size = [], 0
    for r in items.select(item_col, text_of(item_text_col)).toLocalIterator():
        n = max(1, len(r[1]) // 2)  # no text has more shingles
        if block and size + n > block_shingles:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8, words: int = 5, block_shingles: int = 2_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no item; a pass for each block of items, no join."""
    place = docs.columns.index(text_col)

    def without(docs: DataFrame, rows: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(rows)  # at most block_shingles shingles

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Items(sent.value, least, words)
            for batch in slices(batches):
                yield batch.filter(pa.array([next(block.find(t or ""), None) is None for t in batch.column(place).to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    return reduce(without, item_blocks(items, block_shingles, item_col, item_text_col), docs)
