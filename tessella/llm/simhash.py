"""SimHash near-dedup by anchor points of a covering code.

A fingerprint's 64 bits are two halves. The anchors of a half are the words of the perfect
Hamming code of length 31 (covering radius 1), each with the half's last bit free. Of two
fingerprints that differ in at most 3 bits, one half differs in at most 1. There, the anchor
nearest to the first is at most 1 + 1 bits from the second. So each fingerprint goes to all
anchors within radius plus threshold, 2 bits (2 or 17 of each half's 2^27), where it is compared.
No link is lost.

Equal fingerprints are one before anything is compared, so groups of copies cost nothing. An
anchor's members give a spanning forest, never all pairs, and a hot anchor is split (linked());
linked fingerprints become components by star rounds (graph.py).

Null and empty texts have fingerprint 0 and link to each other; the smallest id ignores nulls;
repeated rows are rows of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import HOT_SHARE, field, join_one, materialize, partitions, slices, text_of
from tessella.llm.graph import components

#: Bits in which linked fingerprints may differ; the anchors' radius follows from it.
MOST_BITS = 3
#: Groups at a key up to this size are compared all at once.
SMALL_GROUP = 8
#: Rows of a key that one task compares, and rows of a larger key that all its cells get.
HOT_GROUP, LEADERS = 2048, 16
#: The same where rows carry their sets of shingles, which are compared one with many.
EXACT_GROUP = 128
#: Bytes of shingles of a key that one task compares.
CELL_BYTES = 16 << 20


def fingerprint(text: str, words: int = 3) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64."""
    w = text.encode().lower().split()
    if not w:
        return 0
    n = len(w) - words + 1
    shingles = [b" ".join(w)] if n < 2 else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, max(n, 1))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts in blocks
        set_bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    schema = T.StructType([field(docs, id_col, "doc_id"), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def syndromes(words31: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of 31-bit words: the xor of the places (1 to 31) of set bits, 0 for code words."""
    s = np.zeros(words31.shape, np.uint64)
    for place in range(1, 32):
        s ^= ((words31 >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return s


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp): each unsigned fingerprint at every anchor within 2 bits in a half."""
    one, keys, out = np.uint64(1), [], []

    def put(half: int, free: np.ndarray, code: np.ndarray, fp: np.ndarray) -> None:
        keys.append(np.uint64(half << 32) | free << np.uint64(31) | code)
        out.append(fp)

    for half in (0, 1):
        part = fps >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        free, word = part >> np.uint64(31), part & np.uint64(0x7FFFFFFF)
        s = syndromes(word)
        code = np.where(s > 0, word ^ one << (np.maximum(s, one) - one), word)
        put(half, free, code, fps)
        put(half, free ^ one, code, fps)
        off = s > 0
        word, s, free, fp = word[off], s[off], free[off], fps[off]
        for i in range(1, 32):  # the pairs of places whose xor is the syndrome: code words 2 bits away
            j = np.uint64(i) ^ s
            use = j > i
            put(half, free[use], word[use] ^ np.uint64(1 << (i - 1)) ^ one << (j[use] - one), fp[use])
    return np.concatenate(keys), np.concatenate(out)


def words_of(column: pa.Array) -> np.ndarray:
    """A column of fingerprints, longs or bytes, as rows of unsigned 64-bit words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def column_of(words: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(words[:, 0].view(np.int64)) if pa.types.is_integer(kind) else pa.array([w.tobytes() for w in words], pa.binary())


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ; words after the first WIDTH bits only name the row."""
    bits = slice(0, WIDTH // 64)
    return np.bitwise_count(a[..., bits] ^ b[..., bits]).sum(-1, dtype=np.int64)


class Shingles:
    """Sets of shingle hashes of the rows at to at + n, each a sorted column value, numbered so that one is compared with many at once."""

    def __init__(self, column: pa.Array, at: int, n: int):
        sets = [np.frombuffer(x, np.uint64) for x in column.slice(at, n).to_pylist()]
        self.size = np.array([len(x) for x in sets])
        self.end = np.cumsum(self.size)
        each, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.code, self.in_one = code.ravel(), np.zeros(len(each), bool)

    def own(self, row: int) -> np.ndarray:
        return self.code[self.end[row] - self.size[row] : self.end[row]]

    def similar(self, row: int, others: np.ndarray, least: float) -> np.ndarray:
        """Which others have Jaccard similarity least or more with row."""
        self.in_one[self.own(row)] = True
        if len(others) > SMALL_GROUP:
            both = np.add.reduceat(self.in_one[self.code], self.end - self.size, dtype=np.int64)[others]
        else:
            both = np.array([np.count_nonzero(self.in_one[self.own(j)]) for j in others.tolist()], np.int64)
        self.in_one[self.own(row)] = False
        return both >= least * (self.size[row] + self.size[others] - both) - 1e-9


def near_rows(fp: np.ndarray, row: int, others: np.ndarray, most_bits: int, sets: Shingles | None, least: float) -> np.ndarray:
    """Which others are linked with row: by bits, and by their sets if there are sets."""
    near = differing(fp[others], fp[row]) <= most_bits
    if sets is not None and near.any():
        near[near] = sets.similar(row, others[near], least)
    return near


def group_links(starts: np.ndarray, sizes: np.ndarray, fp: np.ndarray, most_bits: int, shingles: pa.Array | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that link the members of each group, given by starts and sizes.

    Small groups are compared by shifted columns, all at once. A larger group gives a spanning forest: the first row's
    component grows row by row, then that of the first row left; what has been reached is not compared again. With
    shingles all groups of over one row are compared in this way.
    """
    u, v = [], []
    large = sizes > (SMALL_GROUP if shingles is None else 1)
    for at, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        own, rest = fp[at : at + n], np.arange(n)
        sets = None if shingles is None else Shingles(shingles, at, n)
        while len(rest) > 1:
            first, waiting, rest = rest[0], [rest[0]], rest[1:]
            while waiting and len(rest):
                near = near_rows(own, waiting.pop(), rest, most_bits, sets, least)
                found, rest = rest[near], rest[~near]
                waiting += found.tolist()
                u.append(at + found)
                v.append(np.full(len(found), at + first))
    small = (sizes > 1) & ~large
    group = np.repeat(np.arange(len(sizes))[small], sizes[small])
    place = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[small].tolist(), sizes[small].tolist(), strict=True)] or [np.empty(0, np.int64)])
    for shift in range(1, SMALL_GROUP):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(same):
            break
        a, b = place[same + shift], place[same]
        found = differing(fp[a], fp[b]) <= most_bits
        u.append(a[found])
        v.append(b[found])
    return (np.concatenate(u), np.concatenate(v)) if u else (np.empty(0, np.int64), np.empty(0, np.int64))


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(starts, sizes, rows) of groups of equal first columns, in sorted batches; the last group of a batch waits for the next batch."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        keys = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        end = int(starts[-1])
        if end:
            yield starts[:-1], np.diff(starts), rows.slice(0, end)
        waiting = rows.slice(end)
    if waiting is not None:
        yield np.zeros(1, np.int64), np.array([waiting.num_rows]), waiting


def linked(keyed: DataFrame, most_bits: int, hot_group: int = HOT_GROUP, least: float = 0.0) -> DataFrame:
    """(node, root): components of the fingerprints that meet at a key and differ in at most most_bits bits.

    keyed: key long, fp long or binary, each fp once at a key; if it has shingles (binary), linked rows must also have
    Jaccard similarity least or more. A key with more than hot_group rows, or CELL_BYTES of shingles, is dealt over cells
    of about that size, by a hash. Each cell also gets LEADERS rows of the key, through which the cells' rows become one
    component in most cases. Where a key's rows are still in several, those outside its largest component go to all its
    cells and are compared with every row there, so that no link is lost and no task holds more than a cell.
    """
    n, kind = partitions(keyed.sparkSession), keyed.schema["fp"].dataType.simpleString()
    pair = f"u {kind}, v {kind}"
    more = ["shingles"] if "shingles" in keyed.columns else []

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, sizes, rows in whole_groups(batches, 2):
            fp = words_of(rows.column(2))
            u, v = group_links(starts, sizes, fp, most_bits, rows.column(3) if more else None, least)
            yield pa.RecordBatch.from_arrays([column_of(fp[u], rows.column(2).type), column_of(fp[v], rows.column(2).type)], names=["u", "v"])

    def compare_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that came to a cell from others, one after the other, with the cell's own: a link to each component."""
        for starts, sizes, rows in whole_groups(batches, 2):
            fp, root, guest = words_of(rows.column(2)), words_of(rows.column(3)), rows.column(4).to_numpy(zero_copy_only=False)
            u, v = [], []
            for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                k = int(np.count_nonzero(~guest[at : at + size]))  # own rows come first
                sets = Shingles(rows.column(5), at, size) if more and k < size else None
                for g in range(at + k, at + size):
                    near = np.flatnonzero((root[at : at + k] != root[g]).any(1))
                    near = at + near[near_rows(fp[at : at + size], g - at, near, most_bits, sets, least)]
                    each = near[np.unique(root[near], axis=0, return_index=True)[1]]
                    u += [g] * len(each)
                    v += each.tolist()
            yield pa.RecordBatch.from_arrays([column_of(fp[u], rows.column(2).type), column_of(fp[v], rows.column(2).type)], names=["u", "v"])

    load = F.greatest(F.count(F.lit(1)) / hot_group, F.sum(F.length("shingles")) / CELL_BYTES) if more else F.count(F.lit(1)) / hot_group
    hot = materialize(keyed.groupBy("key").agg(load.alias("load"), F.count(F.lit(1)).alias("n")).where("load > 1").select("key", "n", F.ceil("load").cast("int").alias("parts")), "hot")
    cold = hot.isEmpty()
    placed = keyed.select("key", F.lit(None).cast("int").alias("parts"), F.lit(0).alias("cell"), "fp", *more)
    cells = placed.select("key", "cell", "fp", *more)
    if not cold:
        # The largest keys, fewer than HOT_SHARE, meet their number of cells where they are; the others are dealt by key.
        most = hot.agg(F.sum("n")).first()[0] // HOT_SHARE
        largest = F.broadcast(hot.where(F.col("n") > most).select("key", F.col("parts").alias("most_parts")))
        marked = keyed.join(largest, "key", "left")
        others = marked.where("most_parts is null").drop("most_parts").join(hot.where(F.col("n") <= most).select("key", "parts"), "key", "left")
        dealt = marked.where("most_parts is not null").withColumnRenamed("most_parts", "parts").select("key", "fp", *more, "parts").unionByName(others.select("key", "fp", *more, "parts"))
        cell = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.lit(0))
        placed = dealt.select("key", "parts", cell.alias("cell"), "fp", *more)
        leaders = placed.where(F.col("parts").isNotNull() & (F.col("cell") < LEADERS)).groupBy("key", "parts", "cell").agg(F.min(F.struct("fp", *more)).alias("row")).select("key", "parts", "row.*")
        everywhere = leaders.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cell"), "fp", *more)
        cells = placed.select("key", "cell", "fp", *more).unionByName(everywhere)
    roots = components(cells.repartition(n, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(compare, pair))
    if cold:
        return roots
    known = placed.where("parts is not null").join(roots, F.col("fp") == F.col("node"), "left").select("key", "parts", "cell", "fp", F.coalesce("root", "fp").alias("root"), *more)
    known = materialize(known, "known")
    of_key = known.groupBy("key", "root").count().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("count", "root")).alias("most"))
    split = materialize(of_key.where("n > 1").select("key", F.col("most.root").alias("main")), "split")
    if split.isEmpty():
        return roots
    held = join_one(known, split, "key")
    guests = held.where("root <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cell"), "fp", "root", F.lit(True).alias("guest"), *more)
    both = held.select("key", "cell", "fp", "root", F.lit(False).alias("guest"), *more).unionByName(guests)
    links = both.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", "guest").mapInArrow(compare_rest, pair)
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))


def near_groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable)."""
    n = partitions(docs.sparkSession)
    rows = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "groups")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                key, fp = anchors(batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])

    roots = linked(groups.select("fp").repartition(n).mapInArrow(spread, "key long, fp long"), MOST_BITS)
    named = materialize(groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(join_one(named, least, "root").select("fp", "component_id"), "components")
    return join_one(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by a similarity. A covering code serves thresholds of a few bits: the replicas of a
# fingerprint grow with the volume of radius plus threshold. Five-word shingles with Jaccard
# 0.8 differ in 4 to 18 of 64 bits, so no such code is small enough. For a similarity the anchors
# are therefore keys from the text: `BANDS` bands of `BAND` minimum hashes of its shingles. The
# fingerprints that meet at a key, WIDTH bits each, are candidates if few enough bits differ
# (loose_bits()). Each component of candidates then comes together once more with its exact sets
# of shingles (64-bit hashes of them), and only pairs with the asked Jaccard similarity are
# linked. Of pairs with Jaccard 0.8, all but 1 in 2,700 meet.
BANDS, BAND, WIDTH = 20, 5, 256
GOLDEN, MIX = 0x9E3779B97F4A7C15, [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of a hash."""
    h = h + np.uint64(seed * GOLDEN & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * MIX[0]
    h = (h ^ h >> np.uint64(27)) * MIX[1]
    return h ^ h >> np.uint64(31)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted hashes of the text's different shingles."""
    w = text.encode().lower().split()
    n = max(len(w) - words + 1, 1)
    shingles = [b" ".join(w)] if n < 2 else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n))


def loose_bits(similarity: float) -> int:
    """Bits in which candidates may differ. Of sets with this Jaccard similarity a share of bits differs that is the
    angle between them over pi, up to a quarter more for sets of few shingles; five standard deviations are added."""
    p = min(0.5, 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return math.ceil(WIDTH * p + 5 * math.sqrt(WIDTH * p * (1 - p)))


def signature(text: str, words: int) -> tuple[bytes, np.ndarray]:
    """(fingerprint of WIDTH bits and 128 bits that name the set of shingles, keys of BANDS bands)."""
    h = shingle_set(text, words)
    n = len(h)
    set_bits = np.zeros(WIDTH, np.int64)
    least = np.full(BANDS * BAND, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, n, 1 << 14):  # long texts in blocks
        part = h[at : at + (1 << 14)]
        for k in range(WIDTH // 64):
            set_bits[64 * k : 64 * k + 64] += np.unpackbits(mixed(part, k + 1).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        for k in range(len(least)):  # minima of multiply-shift hashes
            least[k] = min(least[k], (part * MULTIPLIERS[k] ^ part >> np.uint64(32)).min())
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        keys = mixed(keys ^ least[k::BAND], k + 1)
    return np.packbits(set_bits * 2 > n, bitorder="little").tobytes() + xxhash.xxh3_128_digest(h.tobytes()), keys


MULTIPLIERS = mixed(np.arange(1, BANDS * BAND + 1, dtype=np.uint64), 7) | np.uint64(1)


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot_group: int = HOT_GROUP) -> DataFrame:
    """The rows of docs, all columns, less those in a group of similar documents that has a smaller id.

    Similar: Jaccard similarity of the sets of shingles, similarity or more; a group is what such pairs connect. Rows that
    share the group's smallest id stay, as do rows without id if their whole group has none. Texts with one set are one
    before they are compared. All text is shuffled once; shingles are shuffled of candidates only.
    """
    of, id_of = F.unhex(F.md5(text_of(f"row.`{text_col}`"))), F.col(f"row.`{id_col}`")
    own = T.StructType([field(docs, id_col, "id"), T.StructField("of_text", T.BinaryType()), T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    whole = docs.select(F.struct("*").alias("row"))  # so that no column of docs clashes with one of ours

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            signed = [signature(t, words) for t in batch.column(2).to_pylist()]
            fps, keys = pa.array([s[0] for s in signed], pa.binary()), pa.array([s[1].view(np.int64) for s in signed], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, keys], names=own.names)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([shingle_set(t, words).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["key", "fp", "shingles"])

    rows = materialize(whole.select(id_of.alias("id"), of.alias("of_text"), text_of(f"row.`{text_col}`").alias("text")).mapInArrow(sign, own), "signed")
    # fp names the set of shingles, so the keys of rows with one fp are equal.
    groups = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.min("keys").alias("keys")), "groups")
    loose = linked(groups.select(F.explode("keys").alias("key"), "fp"), loose_bits(similarity), hot_group)
    named = groups.select("fp", "first_id").join(loose, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.when(F.col("root").isNotNull(), F.xxhash64("root")).alias("candidates"))
    named = materialize(named, "candidates")
    of_text = join_one(rows.select("of_text", "fp").distinct(), named, "fp")
    placed = materialize(join_one(whole.withColumn("of_text", of), of_text, "of_text", rows), "placed")
    some = placed.where("candidates is not null")
    firsts = some.where(id_of.eqNullSafe(F.col("first_id"))).select("candidates", "fp", text_of(f"row.`{text_col}`").alias("text"))
    sets = materialize(firsts.mapInArrow(spell, "key long, fp binary, shingles binary"), "shingles")
    exact = linked(sets, loose_bits(similarity), min(hot_group, EXACT_GROUP), similarity)
    least = named.where("candidates is not null").join(exact, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = materialize(least, "exact-roots")
    least = join_one(least, least.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("fp", "least_id")
    least = materialize(least, "components")
    alone = placed.where(F.col("candidates").isNull() & id_of.eqNullSafe(F.col("first_id"))).select("row.*")
    return alone.unionByName(join_one(some, least, "fp", some).where(id_of.eqNullSafe(F.col("least_id"))).select("row.*"))
