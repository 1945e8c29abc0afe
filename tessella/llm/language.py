"""Language identification with language-bitmask n-gram filters.

The filter is a Bloom filter sliced by bit: each place holds a mask with one bit a language,
in as many 64-bit words as the languages need.
An n-gram sets its language's bit at `hashes` places; the masks at these places, and-ed,
are all languages that contain it, in one look-up. A text's n-grams of letters are looked up,
the bits counted per language, and each count is corrected for the filter's false positives:
(c - n f) / (n - n f) with f, the share of wrong answers expected from how full the
language's slice is. The largest corrected share decides; ties go to the first language by name.

A language contains the n-grams that occur in over `least_share` of its training documents, so
strays from mixed documents stay out and what reaches the driver is bounded: at most
n-grams per document / least_share for each language. Training takes labelled documents, at
most `train_docs` of each language (those of smallest hash); the prediction reads every whole text.

Texts that are null or have no letter are `und` with score 0, and all are where nothing can be
learned. Repeated rows and null ids are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import field, sampled_each, slices

SIZES = (2, 3, 4)
M = np.uint64(0x9E3779B97F4A7C15)
#: A letter is what Unicode calls one; numerals such as a half or a Roman twelve are none. Marks belong to the letters they stand on.
LETTER = regex.compile(r"\p{L}")
BETWEEN, BETWEEN_ASCII = regex.compile(r"[^\p{L}\p{M}]+"), re.compile(r"[^a-z]+")


def words_only(text: str) -> str:
    """The text in lower case, all but letters one space, a space at both ends."""
    text = text.lower()
    return " " + (BETWEEN_ASCII if text.isascii() else BETWEEN).sub(" ", text).strip() + " "


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's n-grams: letters in lower case, all else one space between words and at both ends."""
    points = np.frombuffer(words_only(text).encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ points[i : len(points) - n + 1 + i]) * M
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def training_grams(docs: DataFrame, train_docs: int, least_share: float) -> list:
    """(lang, gram) that occur in over least_share of the language's training documents."""
    chosen = sampled_each(docs.where("lang is not null and text is not null"), train_docs, "doc_id", "lang", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = np.unique(gram_hashes(text)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(grams) + 1), pa.string()), pa.array([None, *grams.tolist()], pa.int64())], names=["lang", "gram"])

    counts = chosen.mapInArrow(run, "lang string, gram long").groupBy("lang", "gram").count()
    total = counts.where("gram is null").select(F.col("lang").alias("of"), F.col("count").alias("docs"))
    return counts.where("gram is not null").join(total, F.col("lang") == F.col("of")).where(F.col("count") > least_share * F.col("docs")).select("lang", "gram").collect()


class GramFilter:
    """The filter: masks at 2^bits places, false-positive rates by language."""

    def __init__(self, grams: list, bits: int = 20, hashes: int = 3):
        self.langs = sorted({r[0] for r in grams})
        self.bits, self.hashes = bits, hashes
        self.masks = np.zeros((max(1, -(-len(self.langs) // 64)), 1 << bits), np.uint64)
        fill = []
        for k, lang in enumerate(self.langs):
            own = np.array([r[1] for r in grams if r[0] == lang], np.int64).view(np.uint64)
            for place in self.places(own):
                self.masks[k // 64, place] |= np.uint64(1 << k % 64)
            fill.append(np.count_nonzero(self.masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / (1 << bits))
        self.wrong = np.array(fill) ** hashes

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """Double hashing."""
        step = (h * M >> np.uint64(17)) | np.uint64(1)
        for i in range(self.hashes):
            yield (h + np.uint64(i) * step) >> np.uint64(64 - self.bits)

    def shares(self, text: str) -> np.ndarray:
        """Corrected shares of the text's n-grams by language."""
        h = gram_hashes(text)
        places, counts = list(self.places(h)), []
        for masks in self.masks:
            held = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
            for place in places:
                held &= masks[place]
            left = min(64, len(self.langs) - len(counts))
            if left <= 8:  # the counts of all masks of eight bits
                of = np.bincount(held.astype(np.int64) & 255, minlength=256)
                counts += [of[(np.arange(256) >> k & 1) == 1].sum() for k in range(left)]
            else:
                counts += [np.count_nonzero(held >> np.uint64(k) & np.uint64(1)) for k in range(left)]
        counts = np.array(counts, float)
        return np.maximum(counts - len(h) * self.wrong, 0) / np.maximum(len(h) * (1 - self.wrong), 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score, its part of all languages' shares."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        s = self.shares(text)
        best = int(s.argmax())
        return self.langs[best], float(s[best] / s.sum()) if s.sum() else 0.0


def identify(docs: DataFrame, train_docs: int = 4000, least_share: float = 0.02) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; crc32 of the id mod 3 is 1 for what is held out."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    grams = GramFilter([tuple(r) for r in training_grams(docs.where(~held), train_docs, least_share)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [grams.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    schema = T.StructType([field(docs, "doc_id"), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, schema)
