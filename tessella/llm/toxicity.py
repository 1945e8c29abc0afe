"""Toxicity scores of deobfuscated text.

Noisy channel: a token that may be disguised (letters mixed with digits or symbols, letters
spelt apart, letters repeated) becomes a lattice of characters. Each symbol has the letters it
may stand for, a run of one letter may be written once or twice, separators may be nothing,
and letters spelt apart may be cut into words anywhere. Any length is decoded.
Viterbi decoding under a character trigram model finds the likeliest word. The model is
counted over all documents. Plain tokens decode to themselves and are not decoded.

Score: logistic regression on which words and word beginnings the restored text has, trained
on at most `train_toxic` and `train_clean` labelled rows (those of smallest hash) whose
crc32(doc_id) mod 5 is not 0. A feature is used if it occurs in enough toxic rows and tells
the labels apart. A document's score depends on its text alone.

Null and empty texts get the score of no feature at all; without labels of both kinds all
scores are the share of toxic ones, 0 without any. Repeated rows and null ids are kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import field, materialize, slices, text_of
from tessella.llm.token_count import Memo

#: Symbols and the letters that they may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
SEPARATORS = set(".-_*~'’`·•/\\,:;^=#%&​­")
#: Log-probabilities of the channel: a symbol for a letter, a separator or repetition that is dropped.
SWAP, DROP = -1.0, -0.5
#: Longer tokens seldom come again: they are decoded each time, not kept.
LONGEST = 40
PLAIN = re.compile(r"[^\W\d_]+\Z")
ENDS = re.compile(r"^[^\w@$!|+(€£¥]+|[^\w@$]+\Z|([^\w])\1+\Z|_+\Z")
REPEATED = re.compile(r"([^\W\d_])\1\1")
SINGLES = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(€£¥])(?:[ .\-_*~]+(?:[^\W_]|[@$!|+(€£¥])){2,}(?!\S)")


class CharModel:
    """Trigrams of letters within words; code 0 is the edge of a word, the last code any rare letter."""

    def __init__(self, counts: list[tuple[str, int]]):
        """counts: (three characters, count), a space for the edge."""
        letters = sorted({c for gram, _ in counts for c in gram} | set("abcdefghijklmnopqrstuvwxyz") | {" "})
        self.code = {c: i for i, c in enumerate(letters)}
        size = len(letters)
        table = np.full((size, size, size), 0.01)
        for gram, n in counts:
            a, b, c = (self.code[x] for x in gram)
            table[a, b, c] += n
        self.log = np.log(table / table.sum(2, keepdims=True))
        self.least = float(self.log.min())

    def step(self, a: str, b: str, c: str) -> float:
        try:
            return float(self.log[self.code[a], self.code[b], self.code[c]])
        except KeyError:
            return self.least


def lattice(token: str, cut: bool = False) -> Iterator[list[tuple[str, float]]]:
    """For each place the strings it may stand for, with the channel's log-probability; runs of one letter are one place.

    With cut, a word may end (a space) after each letter that is left.
    """
    at = 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        n = end - at
        if c.isalpha():
            options = [(c, 0.0 if n == 1 else n * DROP)]
            if n > 1:
                options.append((c * 2, 0.0 if n == 2 else (n - 2) * DROP))
        elif c in LEET:
            options = [(x * k, SWAP * n) for x in LEET[c] for k in {1, min(n, 2)}]
        elif c in SEPARATORS:
            options = [("", n * DROP)]
        else:
            options = [("", 4 * n * DROP)]
        if cut and n > 1 and (c.isalpha() or c in LEET):
            for x in c if c.isalpha() else LEET[c]:
                options += [(x * i + " " + x * j, (n - i - j) * DROP if c.isalpha() else SWAP * n) for i in (1, 2) for j in (1, 2) if i + j <= n]
        if cut and end < len(token):
            options += [(letters + " ", cost) for letters, cost in options if letters]
        yield options
        at = end


def decode(token: str, model: CharModel, cut: bool = False) -> tuple[str, float]:
    """The likeliest word of the lattice, or words with spaces between, and its log-probability; states are the last two letters."""
    best: dict[tuple[str, str], tuple[float, tuple]] = {(" ", " "): (0.0, ())}
    for options in lattice(token, cut):
        reached: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (p, path) in best.items():
            for letters, cost in options:
                x, y, q = a, b, p + cost
                for c in letters:
                    q += model.step(x, y, c)
                    x, y = (" ", " ") if c == " " else (y, c)
                if (x, y) not in reached or q > reached[x, y][0]:
                    reached[x, y] = (q, (path, letters))
        best = reached
    p, path = max(((p if cut and b == " " else p + model.step(a, b, " "), path) for (a, b), (p, path) in best.items()), key=lambda x: x[0])
    word = []
    while path:
        path, letters = path
        word.append(letters)
    return "".join(reversed(word)), p


class Restorer:
    """Texts -> the set of their words, disguised ones restored."""

    def __init__(self, model: CharModel):
        self.model, self.memo = model, Memo(self.word, 150_000)
        self.single = Memo(lambda c: decode(c, model)[1], 5_000)

    def word(self, token: str) -> str:
        """The word of one token in lower case; empty if it has no letter at all."""
        if PLAIN.match(token) and not REPEATED.search(token):
            return token
        core = ENDS.sub("", token)
        core = ENDS.sub("", core)
        if not core or PLAIN.match(core) and not REPEATED.search(core):
            return core
        if not any(c.isalpha() for c in core):
            return ""
        return decode(core, self.model)[0]

    def words(self, text: str) -> set[str]:
        text = text.lower()
        found = {self.memo[t] if len(t) <= LONGEST else self.word(t) for t in set(text.split())}
        for m in SINGLES.finditer(text):
            parts = re.sub(r"[ .\-_*~]+", "", m[0])
            word, p = decode(parts, self.model)
            if p > sum(map(self.single.__getitem__, parts)):  # else they are words of one letter
                found.add(word)
            found.update(decode(parts, self.model, cut=True)[0].split())
        found.discard("")
        return found


def char_counts(docs: DataFrame, text_col: str = "text") -> list[tuple[str, int]]:
    """Trigrams of letters within the words of all documents: each task counts its own, the sums are added up.

    Only trigrams that are over a millionth of all are kept, so fewer than a million reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                points = np.frombuffer((" " + re.sub(r"[\W\d_]+", "  ", text.lower()) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
                grams, n = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
                for g, k in zip(grams.tolist(), n.tolist(), strict=True):
                    total[g] += k
            if len(total) > 500_000:
                yield batch_of(total)
                total.clear()
        if total:
            yield batch_of(total)

    def batch_of(total: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["gram", "n"])

    sums = materialize(docs.select(text_of(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "trigrams")
    whole = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = sums.where(F.col("n") * 1_000_000 > whole).collect()  # fewer than a million
    mask = (1 << 21) - 1
    return [(chr(g >> 42) + chr(g >> 21 & mask) + chr(g & mask), n) for g, n in rows]


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 3 to 8 letters if it goes on."""
    return ["=" + word, *("^" + word[:k] for k in range(3, min(9, len(word))))]


class Scorer:
    """Weights of features; which of them a word has is kept, as words repeat."""

    def __init__(self, bias: float, weights: dict[str, float], model: CharModel):
        self.bias, self.weights, self.restorer = bias, weights, Restorer(model)
        self.memo = Memo(lambda w: tuple(f for f in word_features(w) if f in weights), 150_000)

    def score(self, text: str) -> float:
        has: set[str] = set()
        for w in self.restorer.words(text):
            if own := self.memo[w]:
                has.update(own)
        z = self.bias + sum(self.weights[f] for f in has)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def train(rows: list[tuple[list[int], int]], kept: list[tuple[str, int, int]], rounds: int = 600, decay: float = 0.0005) -> tuple[float, dict[str, float]]:
    """(bias, weights) of a logistic regression with L2 decay by gradient steps with momentum.

    rows: places in kept of a row's features, and its label. kept: (feature, clean rows, toxic rows that have it).
    """
    toxic = sum(y for _, y in rows)
    clean = len(rows) - toxic
    if not toxic or not clean:
        return (0.0 if not rows else 40.0 if toxic else -40.0), {}
    if not kept:
        return math.log(toxic / clean), {}
    x = np.zeros((len(rows), len(kept)), np.float32)
    for r, (places, _) in enumerate(rows):
        x[r, places] = 1
    y = np.array([y for _, y in rows], np.float32)
    ratios = [math.log((n1 + 0.5) / toxic) - math.log((n0 + 0.5) / clean) for _, n0, n1 in kept]
    w, b, dw, db = 0.5 * np.array(ratios, np.float32), np.float32(math.log(toxic / clean)), 0, 0  # starts at half the log-odds of each
    rate = 4.0 / max(1.0, float(x.sum(1).mean() + 1))
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        dw = 0.9 * dw - rate * (x.T @ error / toxic + decay * w)
        db = 0.9 * db - rate * error.mean()
        w, b = w + dw, b + db
    return float(b), {f: float(w[i]) for i, (f, _, _) in enumerate(kept)}


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, train_toxic: int = 2000, train_clean: int = 6000, least_rows: int = 4, most_features: int = 2000) -> tuple[float, dict[str, float], list[tuple[str, int]]]:
    """(bias, weights, character counts). labels: doc_id, toxic.

    Features are counted on the executors; the driver gets the most_features that tell most about the label, and their
    places in each row of the labelled sample.
    """
    counts = char_counts(docs)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isin(0, 1)).withColumn("h", F.xxhash64("doc_id"))
    few = known.where("toxic = 1").orderBy("h", "doc_id").limit(train_toxic).unionByName(known.where("toxic = 0").orderBy("h", "doc_id").limit(train_clean)).select(F.col("doc_id").alias("l_id"), "toxic")
    chosen = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("l_id"))  # at most train_toxic + train_clean labels

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(CharModel(counts))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(restorer.words(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["toxic", "words"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted({f for w in words for f in word_features(w)})
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int32()), pa.array(own, pa.string())], names=["toxic", "feature"])

    sample = materialize(chosen.select("toxic", "text").mapInArrow(restore, "toxic int, words array<string>"), "labelled")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    seen = sample.mapInArrow(spell, "toxic int, feature string").groupBy("feature").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))

    def part(column: str, base: int):
        """Of the log-likelihood ratio of the label given the feature."""
        k = F.col(column)
        return F.when(k > 0, k * F.ln(k * (toxic + clean) / ((F.col("n0") + F.col("n1")) * max(base, 1)))).otherwise(0.0)

    telling = seen.where((F.col("n1") >= least_rows) & (F.col("n1") * clean > 3 * F.col("n0") * toxic)).withColumn("gain", part("n1", toxic) + part("n0", clean))
    kept = [(r["feature"], r["n0"], r["n1"]) for r in telling.orderBy(F.desc("gain"), "feature").limit(most_features).collect()]
    at = {f: i for i, (f, _, _) in enumerate(kept)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [sorted({at[f] for w in words for f in word_features(w) if f in at}) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], names=["toxic", "places"])

    rows = sorted((list(r["places"]), r["toxic"]) for r in sample.mapInArrow(place, "toxic int, places array<int>").collect())  # the labelled sample
    bias, weights = train(rows, kept)
    return bias, weights, counts


def score(docs: DataFrame, model: tuple, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    bias, weights, counts = model
    sent = docs.sparkSession.sparkContext.broadcast((bias, {f: w for f, w in weights.items() if abs(w) > 1e-4}, counts))  # at most 3,000 features and the trigrams of common letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w, c = sent.value
        scorer = Scorer(b, w, CharModel(c))
        for batch in slices(batches):
            s = [scorer.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= least) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([field(docs, "doc_id"), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select("doc_id", held_out().alias("held_out"), text_of("text").alias("text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under least; one pass, no join."""
    bias, weights, counts = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((bias, {f: w for f, w in weights.items() if abs(w) > 1e-4}, counts))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w, c = sent.value
        scorer = Scorer(b, w, CharModel(c))
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.score(t or "") < least for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
