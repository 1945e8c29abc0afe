"""Secret scans, in DataFrame operations only.

Base rules find assignments, access keys and hexadecimal runs. In what the assignments leave,
runs of identifier characters that hold no access key or hexadecimal run are scored by two
first-order Markov models of characters, one of random strings and one of ordinary
identifiers: the sum of log-likelihood ratios of their character pairs decides. Models and
threshold come from labelled samples: random strings are made from digests, ordinary ones are
words of at most `train_docs` documents (those of smallest hash), joined as identifiers are, and a
few fixed ones. Three quarters train; the threshold is set on the rest (least_ratio()). The model
is one number per pair of 67 characters.

The scan itself is one projection: no shuffle. Positions, in code points, are running sums
of the lengths of gaps and matches, made in blocks (starts_of()), and a run is scored in
pieces, so a row's work grows with its text and not with its square. Texts that match no rule
take the short way. Null texts are empty; an empty table gives an empty result; repeated rows
and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import sampled, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are long enough; what is shorter fails as a whole, so a run never starts later.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of a run that are scored at once, and lengths that are summed at once.
PIECE, BLOCK = 4096, 64
EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
ORDINARY = [
    "get_user_name", "maxRetryCount", "initialize_connection_pool", "BackgroundTaskScheduler", "http/static/images/logo", "DEFAULT_BUFFER_SIZE", "on-click-outside-handler", "com/example/service/impl",
    "ThisIsAnOrdinaryClassName", "read_configuration_file", "application/x-www-form-urlencoded", "content-security-policy", "org/apache/commons/lang", "version_2_release_notes", "2024-01-31", "2019-12-01",
]
# The expressions are SQL texts, as a Column a lambda function at a time takes seconds to build.


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """body with the value by name, which is worked out once however often body has it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def starts_of(lengths: str, level: int = 3) -> str:
    """Running sums before each element. Blocks of BLOCK are summed by themselves, then their totals in the same way."""

    def within(block: str, first: str) -> str:
        return f"slice(aggregate({block}, array({first}), (sums, n) -> concat(sums, array(element_at(sums, -1) + n))), 1, size({block}))"

    x, bs = f"x{level}", f"bs{level}"
    if not level:
        return let(x, lengths, within(x, "0"))
    blocks = f"transform(sequence(0, cast((size({x}) - 1) div {BLOCK} as int)), b -> slice({x}, b * {BLOCK} + 1, {BLOCK}))"
    totals = f"transform({bs}, b -> aggregate(b, 0, (t, n) -> t + n))"
    long = let(bs, blocks, f"flatten(zip_with({bs}, {starts_of(totals, level - 1)}, (b, first) -> {within('b', 'first')}))")
    return let(x, lengths, f"CASE WHEN size({x}) <= {BLOCK} THEN {within(x, '0')} ELSE {long} END")


def pieces(text: str, pattern: str, value: int = 0) -> str:
    """An array of structs (start, end, between, found, value) of the leftmost matches that do not overlap, and one with a null
    `found` for what stands after the last. between: what stands before the match; begin: where that begins; value: a group."""
    q = quoted(pattern)
    both = f"zip_with(split({text}, {q}, -1), zip_with(regexp_extract_all({text}, {q}, 0), regexp_extract_all({text}, {q}, {value}), (f, v) -> named_struct('found', f, 'value', v)), (g, m) -> named_struct('between', g, 'm', m))"
    lengths = "transform(parts, p -> length(p.between) + coalesce(length(p.m.found), 0))"
    each = "named_struct('begin', at, 'between', p.between, 'start', at + length(p.between), 'end', at + length(p.between) + length(p.m.found), 'found', p.m.found, 'value', p.m.value)"
    return let("parts", both, f"zip_with(parts, {starts_of(lengths)}, (p, at) -> {each})")


def spans(text: str, pattern: str, kind: int, value: int = 0, least: int = 0) -> str:
    """An array of (start, kind, end) of the matches, those whose value is at least so long."""
    held = f"filter({pieces(text, pattern, value)}, s -> s.found IS NOT NULL AND length(s.value) >= {least})"
    return f"CASE WHEN {text} RLIKE {quoted(pattern)} THEN transform({held}, s -> named_struct('start', s.start, 'kind', {kind}, 'end', s.end)) ELSE {EMPTY} END"


def ratio(run: str, model: str = "model") -> str:
    """The log-likelihood ratio of a run: the sum over its pairs of characters, piece by piece; each piece goes with the character after it."""
    q = quoted(f"(?s)(.{{1,{PIECE}}})(?=(.?))")
    parts = f"zip_with(regexp_extract_all({run}, {q}, 1), regexp_extract_all({run}, {q}, 2), (a, b) -> concat(a, b))"
    codes = f"transform(split(part, ''), c -> CASE WHEN c = '' THEN 0 ELSE instr('{ALPHABET}', c) END)"
    pairs = let("codes", codes, f"zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes)), (a, b) -> a * {len(ALPHABET) + 1} + b + 1)")
    return f"aggregate({parts}, 0D, (s, part) -> s + aggregate({pairs}, 0D, (t, k) -> t + element_at({model}, k)))"


def random_runs(text: str, least: float, begin: str = "0") -> str:
    """An array of (start, kind, end) of the random runs of a stretch of the text that begins at `begin`."""
    base = quoted(f"{ACCESS}|{HEX}")
    held = f"filter({pieces(text, RUN)}, r -> r.found IS NOT NULL AND NOT r.found RLIKE {base} AND {ratio('r.found')} > {least})"
    return f"transform({held}, r -> named_struct('start', {begin} + r.start, 'kind', 3, 'end', {begin} + r.end))"


def samples(docs: DataFrame, train_docs: int = 2000, random_strings: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled samples (text, random): digests in three spellings; words of documents, alone and joined, and fixed identifiers."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    made = spark.range(random_strings).select(F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, packed).otherwise(F.upper(F.regexp_replace(packed, "[+/=]", ""))).alias("text"), F.lit(True).alias("random"))
    chosen = sampled(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), train_docs, "doc_id", "text")
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.length(w).between(2, 40))

    def word(i: Column) -> Column:
        return F.coalesce(F.get("w", i), F.lit(""))

    def joint(i: Column) -> Column:
        return F.when(i % 4 == 0, "_").when(i % 4 == 1, "-").when(i % 4 == 2, "/").otherwise("")

    places = F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1)))
    joined = F.transform(places, lambda i: F.concat(word(i - 1), joint(i), word(i)))
    longer = F.transform(F.filter(places, lambda i: i % 4 == 1), lambda i: F.concat(*(x for k in range(4) for x in ((joint((i - 1) / 4), word(i - 1 + k)) if k else (word(i - 1),)))))
    ordinary = chosen.select(words.alias("w")).select(F.explode(F.concat("w", joined, longer)).alias("text")).select("text", F.lit(False).alias("random"))
    fixed = spark.createDataFrame([(x, False) for x in ORDINARY], "text string, random boolean")
    return made.unionByName(ordinary).unionByName(fixed)


def table_of(model: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(model)), "array<double>")


def train(labelled: DataFrame, prior: float = 5.0) -> tuple[list[float], float]:
    """(log-likelihood ratios by pair of characters, the ratio over which a run is a secret).

    Place 68 * first + second of the list; 0 is any other character. What follows a rare character is taken from the
    characters at large, as `prior` pairs of them. A quarter of the samples, by hash, is left for the threshold.
    """
    rest = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    code = "instr('%s', substr(text, i + {}, 1))" % ALPHABET
    pairs = labelled.where(~rest).selectExpr("random", f"explode(transform(sequence(1, greatest(length(text) - 1, 1)), i -> named_struct('a', {code.format(0)}, 'b', {code.format(1)}))) AS p").groupBy("random", "p.a", "p.b").count()
    n = len(ALPHABET) + 1
    counts = {k: [[0] * n for _ in range(n)] for k in (True, False)}
    for r in pairs.collect():  # at most 2 * 68 * 68 rows
        counts[r["random"]][r["a"]][r["b"]] += r["count"]

    def log_table(own: list[list[int]]) -> list[float]:
        seconds = [sum(row[b] for row in own) + 0.5 for b in range(n)]
        share = [s / sum(seconds) for s in seconds]
        return [math.log((row[b] + prior * share[b]) / (sum(row) + prior)) for row in own for b in range(n)]

    model = [x - y for x, y in zip(log_table(counts[True]), log_table(counts[False]), strict=True)]
    return model, least_ratio(labelled.where(rest), model)


def least_ratio(labelled: DataFrame, model: list[float], false_share: float = 0.001, missed_share: float = 0.01) -> float:
    """The threshold from samples of 20 characters or more that the models have not seen, random ones cut to that length.

    It is halfway between the ratio that false_share of the ordinary ones exceed and the one that missed_share of the random
    ones stay under; if these overlap, the first of them. A run is a secret at odds of e or more at least.
    """
    cut = F.when(F.col("random"), F.substring("text", 1, 20)).otherwise(F.col("text"))
    scored = labelled.where(F.length("text") >= 20).select("random", cut.alias("run"), table_of(model).alias("model")).selectExpr("random", f"{ratio('run')} AS ratio")
    ends = scored.agg(F.percentile(F.when(~F.col("random"), F.col("ratio")), F.lit(1 - false_share)).alias("low"), F.percentile(F.when(F.col("random"), F.col("ratio")), F.lit(missed_share)).alias("high")).first()
    low, high = ends["low"] if ends["low"] is not None else 0.0, ends["high"] if ends["high"] is not None else 0.0
    return max(1.0, (low + high) / 2 if high > low else low)


def scan(docs: DataFrame, model: tuple[list[float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_markov for each row of docs."""
    table, least = model
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), table_of(table).alias("model"))
    base = f"concat({spans('text', ASSIGN, 0, 2, 6)}, {spans('text', ACCESS, 1)}, {spans('text', HEX, 2)})"
    gaps = f"flatten(transform(filter({pieces('text', ASSIGN)}, g -> g.between RLIKE {quoted(RUN)}), g -> {random_runs('g.between', least, 'g.begin')}))"
    more = f"CASE WHEN NOT text RLIKE {quoted(RUN)} THEN {EMPTY} WHEN text RLIKE {quoted(ASSIGN)} THEN {gaps} ELSE {random_runs('text', least)} END"
    found = rows.selectExpr("doc_id", f"{base} AS base", f"{more} AS more")
    names = F.array(*map(F.lit, KINDS))

    def said(column: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")

    def n_of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", n_of(0).alias("n_assign"), n_of(1).alias("n_access"), n_of(2).alias("n_hex"), F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_markov"),
    )


def find_secrets(docs: DataFrame, train_docs: int = 2000) -> DataFrame:
    return scan(docs, train(samples(docs, train_docs)))
