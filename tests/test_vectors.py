"""Vector functions: SQL's rounding, zeros with a sign included, and values that are computed once a row."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.functions import vectors as V
from tessella.operators import indexes as I


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """A folder with `embeddings` whose numbers are near zero on both sides here and there."""
    r = np.random.default_rng(7)
    x = r.normal(size=(60, 64)).astype(np.float32)
    x[r.random(x.shape) < 0.1] *= 1e-7
    x[:, 20] = -np.abs(x[:, 20]) * 1e-8
    at = str(tmp_path_factory.mktemp("tiny"))
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


def test_rounding_is_that_of_sql(spark):
    values = [0.0, -0.0, 1e-9, -1e-9, 4.999e-7, -5e-7, 5e-7, 0.0078125, -0.0078125, 0.1234565, -0.1234565, 2.5, 1e10 / 3, -1e17 / 3, 1e300, -1e308, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for digits in (0, 5, 6):
        got = [repr(r[0]) for r in df.orderBy("i").select(V.rounded("v", digits)).collect()]
        assert got == [repr(duckdb.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchone()[0]) for v in values]


@pytest.mark.parametrize("name", ["pca_back", "str_csv_vec", "vec_l2norm", "vec_permute", "vec_residual", "vec_slice", "vec_ubc_reorder"])
def test_zeros_keep_the_sign_of_the_sql(spark, tiny, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet/*.parquet'")
    want = sorted(c.execute(entry.oracle_sql()[name]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()[name](spark, tiny).collect())
    assert "-0.0" in repr(want) and repr(got) == repr(want)


def test_sums_of_a_row_are_computed_once(spark):
    """Sums within a lambda were computed again for each element, 60 ms a row."""
    df = spark.range(3000).select(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i)).alias("x")).localCheckpoint()
    began = time.perf_counter()
    df.select(V.root_sift(F.col("x")).alias("v")).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 15


def test_tracks_and_images_are_counted_without_pairs(spark, tmp_path):
    """agg_model_stats against its SQL with null keys; no group of (order, supplier) is made."""
    rows = [(o, s, d) for o, s, d in [(1, 1, 0.1), (1, 1, 0.2), (2, 1, None), (None, 2, 0.4), (3, None, 0.0), (3, 2, 0.05)]]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entry.queries()["agg_model_stats"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert [tuple(r) for r in out.collect()] == c.execute(entry.oracle_sql()["agg_model_stats"]).fetchall()
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_bit_strings_are_not_shuffled_to_be_distinct(spark):
    """Rows that meet at several tables count once, against brute force, on bit strings of two longs."""
    r = np.random.default_rng(8)
    rows = [(i, [int(v) for v in r.integers(-(1 << 62), 1 << 62, 2)]) for i in range(60)]
    rows += [(60 + i, [b[0] ^ (1 << 63) - 1 & 5, b[1] ^ (-1 << 63)]) for i, b in rows]
    df = spark.createDataFrame(rows, "id long, bits array<long>")
    index = I.BitSampling(df, 128, tables=3, key_bits=8, seed=2)
    found = index.search(df.where("id % 20 = 0").select(F.col("id").alias("qid"), "bits"), 200, 1)
    bits = {i: sum((w & (1 << 64) - 1) << 64 * n for n, w in enumerate(b)) for i, b in rows}
    masks = [sum(1 << p for p in places) for places in index.positions]
    want = {(q, i, float((bits[q] ^ bits[i]).bit_count())) for q in bits if q % 20 == 0 for i in bits if any(((bits[q] ^ bits[i]) & m).bit_count() <= 1 for m in masks)}
    got = [tuple(v)[:3] for v in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Deduplicate" not in found._jdf.queryExecution().analyzed().toString() and "Distinct" not in found._jdf.queryExecution().analyzed().toString()
