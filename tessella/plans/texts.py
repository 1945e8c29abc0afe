"""Text functions over `documents`, `benchmark` and `part`, and scalar mathematics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import vectors as V
from tessella.plans import query, table


def over(name, tab, key, sql, columns):
    """columns: () -> name -> Column; sql: the same columns over the table."""

    @query(name, f"SELECT {key}, {sql} FROM {tab}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, tab).select(key, *(c.alias(n) for n, c in columns().items()))


RANGES = r"[^a-zA-Z0-9\x{2e80}-\x{2fd5}\x{3190}-\x{319f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fcc}\x{f900}-\x{faad}]"
over("str_split_sentence", "documents", "doc_id", "list_filter(string_split_regex(text, '[,，.。!！?？]'), lambda x: x <> '') AS parts", lambda: {"parts": X.split_sentence(F.col("text"))})
@query("str_seg_sentence", r"SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS parts FROM (SELECT doc_id, string_split_regex(text, '，|？|。|：| |,|!|！|\.\.\.|……|\?|@') AS p FROM documents)")
def str_seg_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.segment(F.col("text")).alias("parts"))


over("str_filter_special", "documents", "doc_id", f"regexp_replace(text, '{RANGES}', '', 'g') AS t", lambda: {"t": X.filter_special(F.col("text"))})
over("str_split_char", "documents", "doc_id", r"CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1] ELSE string_split(text, chr(10)) END AS parts", lambda: {"parts": X.split_by(F.col("text"), "\n")})
over("str_split_any", "documents", "doc_id", r"string_split_regex(text, '[ ,.]+') AS parts", lambda: {"parts": X.split_any(F.col("text"), " ,.")})
over("str_replace", "documents", "doc_id", "replace(text, 'en', '<>') AS t", lambda: {"t": F.replace(F.col("text"), F.lit("en"), F.lit("<>"))})
over("str_get_after", "documents", "doc_id", "CASE WHEN contains(text, 'an') THEN string_split(text, 'an')[-1] ELSE '' END AS t", lambda: {"t": X.get_after(F.col("text"), "an")})
over("str_starts_with", "documents", "doc_id", "starts_with(text, 'The') AS a, false AS b, contains(text, 'the') AS c", lambda: {"a": X.starts_with(F.col("text"), "The"), "b": X.starts_with(F.col("text"), ""), "c": F.contains(F.col("text"), F.lit("the"))})
over("str_trim", "documents", "doc_id", r"regexp_replace(' ' || text || chr(9) || chr(10), '^[ \n\r\t]+|[ \n\r\t]+$', '', 'g') AS t", lambda: {"t": X.trimmed(F.concat(F.lit(" "), F.col("text"), F.lit("\t\n")))})
over("str_case_format", "part", "p_partkey", "lower(p_name) AS l, upper(p_name) AS u, format('{:05d}/{}', p_partkey, p_brand) AS f", lambda: {"l": F.lower("p_name"), "u": F.upper("p_name"), "f": F.format_string("%05d/%s", "p_partkey", "p_brand")})
over("str_csv_vec", "embeddings", "vec_id", "list_transform(embedding, lambda v: round(v::DOUBLE, 5)) AS v", lambda: {"v": F.transform(X.floats(X.csv(F.transform("embedding", lambda v: V.rounded(v, 5)))), lambda v: v)})
over("str_label_prefix", "part", "p_partkey", "split_part(replace(p_type, ' ', '_'), '_', 1) AS t", lambda: {"t": X.label_prefix(F.replace("p_type", F.lit(" "), F.lit("_")))})
over(
    "str_basename", "pages", "page_id", r"string_split(url, '/')[-1] AS base, regexp_replace(url, '\.[^./]*$', '') AS stem, regexp_replace(url, '/+$', '') || '/x.txt' AS joined",
    lambda: {"base": X.basename(F.col("url")), "stem": X.without_extension(F.col("url")), "joined": X.path_join(F.col("url"), F.lit("x.txt"))},
)
over("str_utf8_wide", "documents", "doc_id", "strlen(text) AS n_bytes, length(text) AS n_chars", lambda: {"n_bytes": F.octet_length(F.col("text")).cast("long"), "n_chars": F.length(F.col("text")).cast("long")})
over("str_binary_dump", "part", "p_partkey", "lpad(bin(p_partkey * 7), 64, '0') AS b", lambda: {"b": X.binary_dump(F.col("p_partkey") * 7)})


@query("str_ngram", "SELECT item_id, (i - 1)::INT AS at, substr(text, i, 3) AS gram FROM benchmark, range(1, 100000) t(i) WHERE i <= length(text) - 2")
def str_ngram(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.explode(X.ngrams(F.col("text"), 3)).alias("g")).select("item_id", "g.at", "g.gram")


@query("prj_json_config", "SELECT event_id, props->>'$.page' AS page, (props->>'$.ref') IS NOT NULL AS has_ref FROM events")
def prj_json_config(spark, sf_dir):
    """A configuration in JSON, by key."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").isNotNull().alias("has_ref"))


@query(
    "math_scalars",
    "SELECT l_orderkey, l_linenumber, sign(l_discount - 0.05)::INT AS s, least(30, greatest(10, l_quantity)) AS clip, round(radians(l_quantity), 6) AS rad, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS sig, trunc(l_extendedprice)::BIGINT AS t FROM lineitem",
)
def math_scalars(spark, sf_dir):
    """Sign, clipping, radians, a scaled sigmoid, truncation."""
    q = F.col("l_quantity")
    own = {"s": F.signum(F.col("l_discount") - 0.05).cast("int"), "clip": F.least(F.lit(30.0), F.greatest(F.lit(10.0), q)), "rad": F.round(F.radians(q), 6), "sig": F.round(1 / (1 + F.exp(-(q - 25) / 10)), 6), "t": F.col("l_extendedprice").cast("long")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in own.items()))


@query("math_combinations", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def math_combinations(spark, sf_dir):
    """All combinations of two of the 25 nations."""
    k = table(spark, sf_dir, "nation").select("n_nationkey")
    return k.select(F.col("n_nationkey").alias("a")).join(F.broadcast(k.select(F.col("n_nationkey").alias("b"))), F.col("a") < F.col("b"))  # 25 rows
