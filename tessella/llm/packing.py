"""Bounded-space online packing of token sequences.

A task reads its documents in order and keeps at most `windows` open windows. A piece goes
to the open window that it leaves with the least space; if it fits in none, the fullest
window is filled up by cutting the piece, and emitted. Whole windows of long documents are
emitted at once. At the end a task merges what is open, so that at most one window of a
partition is not full; these leftovers, with their ids, are merged over all partitions by
a running sum of their lengths. Only the very last sequence of all can need padding.

A task holds `windows` windows and one document, whatever the input's size. The packed
pieces are written to the shared folder before leftovers are merged, so tokens are made once.

Null and empty texts are the end id alone; repeated rows are packed each; ids may be null;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import field, materialize, slices, text_of
from tessella.llm.token_count import Memo, byte_symbols

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Texts -> ids. tokens hold what stands between white space, words the pre-tokens; both repeat much."""

    def __init__(self, content: str, most_words: int = 100_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.model = self.library.model
        self.special = {t.content: i.to_bytes(4, "little") for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        find, self.odd = regex.compile(WORDS).findall, re.compile("[\x1c-\x1f\u03a3]").search
        self.bytes = {b: ord(c) for b, c in byte_symbols().items()}
        self.words = Memo(self.word, most_words)
        self.tokens = Memo(lambda t: self.words[t] if t.isalpha() else b"".join(map(self.words.__getitem__, find(t))), 4 * most_words)

    def encoded(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """The merges of one pre-token, its bytes written as the vocabulary's symbols."""
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(symbols)])

    def plain(self, text: str) -> bytes:
        if self.odd(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self.encoded(text)  # final sigma, odd separators and composition: the library's own rules
        return b"".join(map(self.tokens.__getitem__, text.lower().split()))

    def ids(self, text: str) -> bytes:
        if self.cut is not None and any(s in text for s in self.special):
            return b"".join(self.special.get(p) or self.plain(p) for p in self.cut.split(text) if p)
        return self.plain(text)


#: The encoders of this worker process, by vocabulary: tasks that it runs later find the words made.
_ENCODERS: dict[int, WordIds] = {}


def encoder_of(content: str) -> WordIds:
    if (key := zlib.crc32(content.encode())) not in _ENCODERS:
        _ENCODERS[key] = WordIds(content)
    return _ENCODERS[key]


class Packer:
    """The open windows of one partition. A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.open: list[list] = []  # each: [space left, pieces]

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        """Place a document; yields the pieces of each window that it makes full."""
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            yield [(doc, at, ids[4 * at : 4 * (at + self.size)], total)]
            at += self.size
        while at < total:
            need = total - at
            fits = [w for w in self.open if w[0] >= need]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(best := [self.size, []])
            else:
                best = min(self.open, key=lambda w: w[0])  # the fullest: filled up, then emitted
            n = min(need, best[0])
            best[1].append((doc, at, ids[4 * at : 4 * (at + n)], total))
            best[0] -= n
            at += n
            if not best[0]:
                self.open = [w for w in self.open if w is not best]
                yield best[1]

    def merged(self) -> Iterator[tuple[bool, list[tuple]]]:
        """The open windows merged: full ones first, then the rest; True with a full one."""
        space, pieces = self.size, []
        for _, held in sorted(self.open, key=lambda w: w[0]):
            for doc, start, ids, total in held:
                at, n = 0, len(ids) // 4
                while at < n:
                    take = min(space, n - at)
                    pieces.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                    at, space = at + take, space - take
                    if not space:
                        yield True, pieces
                        space, pieces = self.size, []
        if pieces:
            yield False, pieces
        self.open = []


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], size: int = 2048, windows: int = 32, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.

    encoder: called once a task, gives text -> ids as little-endian unsigned 32-bit bytes.
    """
    fields = [field(docs, id_col, "doc_id"), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    names = [f.name for f in fields]
    end = end_id.to_bytes(4, "little")

    def batch_of(rows: list[tuple], like: pa.DataType, more: pa.DataType | None = None) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], like), *(pa.array(c, pa.int64()) for c in columns[1:7])]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[7], more)] if more else arrays, names=[*names, "ids"] if more else names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = encoder(), Packer(size, windows), []
        first, done, like = (TaskContext.get().partitionId() + 1) << 32, 0, pa.int64()

        def put(pieces: list[tuple], sequence: int, keep: bool) -> None:
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, at, ids if keep else None))
                at += n

        for batch in slices(batches):
            like = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pieces in packer.add(doc, encode(text) + end):
                    put(pieces, first + done, False)
                    done += 1
            if rows:
                yield batch_of(rows, like, pa.binary())
                rows.clear()
        for full, pieces in packer.merged():
            put(pieces, first + done, not full)
            done += 1
        if rows:
            yield batch_of(rows, like, pa.binary())

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leftover pieces at their place in the run of all leftovers, cut where sequences end."""
        for batch in batches:
            like, rows = batch.schema.field(0).type, []
            for r in batch.to_pylist():
                at = 0
                while at < r["length"]:
                    place = r["place"] + at
                    n = min(size - place % size, r["length"] - at)
                    rows.append((r["doc_id"], r["start"] + at, n, zlib.crc32(r["ids"][4 * at : 4 * (at + n)]), r["doc_tokens"], place // size, place % size))
                    at += n
            if rows:
                yield batch_of(rows, like)

    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    packed = materialize(source.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.BinaryType())])), "packed")
    left = packed.where("ids is not null")
    # One row for each partition that has a leftover: its length, and the lengths before it.
    before = left.groupBy("sequence_id").agg(F.sum("length").alias("n")).select(F.col("sequence_id").alias("own"), (F.sum("n").over(W.orderBy("sequence_id")) - F.col("n")).alias("before"))
    placed = left.join(before, left["sequence_id"] == before["own"]).withColumn("place", F.col("before") + F.col("offset"))
    rest = placed.select("doc_id", "start", "length", "doc_tokens", "ids", "place").mapInArrow(recut, T.StructType(fields))
    return packed.where("ids is null").select(*names).unionByName(rest)


def word_encoder(vocabulary: str, spark) -> Callable[[], Callable[[str], bytes]]:
    """An encoder for pack() of the tokenizers file at the path; the file is read on the driver once."""
    with open(vocabulary, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file: about 2 MB whatever the input
    return lambda: encoder_of(content.value).ids
