"""Token counts by byte-pair merging with a heap and a linked list.

Every pre-token is a linked list of byte symbols; the adjacent pair of lowest rank is
popped from a heap and merged until none is left. The count is the number of initial
symbols less the number of merges, so no identifiers are made. Counts of pre-tokens are
kept in bounded tables of the worker process, as words repeat.

Nulls and empty texts have 0 tokens; ties between equal ranks go to the leftmost pair;
repeated rows are counted each; an empty table gives an empty result; other columns are
ignored. No row depends on another, so there is no shuffle and no state to lose.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm._common import field, slices, text_of

#: White space as the vocabulary's own pattern has it (Python's also counts the separators 1C to 1F).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


class Memo(dict):
    """Key -> value, made on demand; emptied at `most` entries or MOST_CHARS characters of keys to bound memory. Long keys, which seldom come again, are not kept."""

    LONGEST, MOST_CHARS = 256, 16_000_000

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.chars = make, most, 0

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) > self.LONGEST:
            return value
        if len(self) >= self.most or self.chars > self.MOST_CHARS:
            self.clear()
            self.chars = 0
        self[key] = value
        self.chars += len(key)
        return value


class MergeCounter:
    """Counts of texts; words hold pre-tokens, spaced and bare what stands between spaces, with and without the space before it."""

    def __init__(self, vocabulary: dict, most_words: int = 600_000):
        model = vocabulary["model"]
        ids: dict[str, int] = dict(model["vocab"])
        self.first = [ids[c] for _, c in sorted(byte_symbols().items())]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] << 24 | ids[b], (rank << 40, ids[a + b]))
        self.special = [t["content"] for t in vocabulary.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.runs = re.compile(rf"[{SPACE}]{{2}}").search
        self.words = Memo(lambda w: self.merged(w.encode()), most_words)
        self.spaced = Memo(lambda w: self.words[" " + w] if w.isalpha() else self.pieces(" " + w), 2 * most_words)
        self.bare = Memo(self.pieces, most_words // 2)

    def merged(self, data: bytes) -> int:
        """Initial symbols less merges. Heap entries are rank << 40 | place."""
        size, first, merges = len(data), self.first, self.merges
        symbol = [first[b] for b in data]
        heap = [m[0] | i for i in range(size - 1) if (m := merges.get(symbol[i] << 24 | symbol[i + 1]))]
        if not heap:
            return size
        left, right = list(range(-1, size - 1)), [*range(1, size), -1]
        heapq.heapify(heap)
        done = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = right[i]
            if j < 0 or symbol[i] < 0 or (m := merges.get(symbol[i] << 24 | symbol[j])) is None or m[0] | i != top:
                continue  # one of the two was merged meanwhile
            new = m[1]
            symbol[i], symbol[j] = new, -1
            k = right[i] = right[j]
            done += 1
            if k >= 0:
                left[k] = i
                if m := merges.get(new << 24 | symbol[k]):
                    heapq.heappush(heap, m[0] | i)
            if (h := left[i]) >= 0 and (m := merges.get(symbol[h] << 24 | new)):
                heapq.heappush(heap, m[0] | h)
        return size - done

    def pieces(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.find(text)))

    def count(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(self.count_plain(p) for p in parts)
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        """Without two white-space characters in a row, no pre-token goes beyond a space or a line end."""
        if self.runs(text):
            return self.pieces(text)
        lines, spaced, bare = text.split("\n"), self.spaced.__getitem__, self.bare.__getitem__
        n = len(lines) - 1
        for line in lines:
            first, *rest = line.split(" ")
            n += bare(first) + sum(map(spaced, rest))
        return n


#: The counters of this worker process, by vocabulary: tasks that it runs later find the words counted.
_COUNTERS: dict[int, MergeCounter] = {}


def counter_of(content: str) -> MergeCounter:
    if (key := zlib.crc32(content.encode())) not in _COUNTERS:
        _COUNTERS[key] = MergeCounter(json.loads(content))
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. vocabulary: path of a byte-level BPE in JSON.

    The file is read on the driver once and sent to each task, so workers need no access to it.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: about 2 MB whatever the input
    source = docs.select(id_col, text_of(text_col).alias("text"))
    schema = T.StructType([field(docs, id_col, "doc_id"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(content.value)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, schema)
