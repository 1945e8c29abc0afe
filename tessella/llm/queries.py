"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm._common import documents, step_path
from tessella.llm.decontaminate import contained
from tessella.llm.exact_dedup import exact_groups
from tessella.llm.html_text import extract
from tessella.llm.language import identify
from tessella.llm.packing import pack, word_encoder
from tessella.llm.secrets import find_secrets
from tessella.llm.simhash import near_groups
from tessella.llm.token_count import count_tokens
from tessella.llm.toxicity import toxicity
from tessella.llm.warc import archive_index, write_archive


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = step_path(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return archive_index(spark, path)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), word_encoder(public_tokenizers.path("word_bpe_49k.json"), spark))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_exact_dedup, op4_warc, op5_html_text, op6_toxicity, op7_language, op8_packing, op9_simhash, op10_token_count)}


ORACLE = {
    "op1_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
             i AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
             ds AS (SELECT DISTINCT r, doc_id, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM d WHERE len(w) > 0)),
             s AS (SELECT DISTINCT r, item_id, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT r, item_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM i WHERE len(w) > 0)),
             n AS (SELECT r, count(*) AS n_item FROM s GROUP BY r)
        SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
        FROM ds JOIN s USING (s) JOIN n ON n.r = s.r GROUP BY ds.r, doc_id, s.r, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-9)""",
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
