"""Text functions on odd texts, against SQL."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.functions import text as X


def test_split_of_empty_texts_is_that_of_sql(spark, tmp_path):
    odd = ["", None, "\n", "\n\n", "a\n", "a\n\n", "\na", "a\r\nb", "\r", " \n ", "%\n", "é\n", "\\E\n|"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in entry.queries()["str_split_char"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(entry.oracle_sql()["str_split_char"]).fetchall()) and got[0] == (0, [""])


def test_numbers_of_empty_text_are_none(spark):
    df = spark.createDataFrame([("",), ("1, 2.5,",), (None,)], "s string")
    assert [r[0] for r in df.select(X.floats(F.col("s"))).collect()] == [[], [1.0, 2.5], None]
