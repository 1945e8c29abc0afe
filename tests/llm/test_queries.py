"""The SQL of the training-data operators against their queries, clashing columns, and the folders of steps."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.llm import _common as C
from tessella.llm import language as L
from tessella.llm import simhash as S
from tessella.llm import toxicity as T
from tests.llm.common import frame, sentence
from tests.llm.test_text_models import language_docs, toxic_docs
from tests.test_oracles import DIR, TABLES, plain


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_sql_of_the_operators(spark):
    import duckdb

    from tessella.llm import queries

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, DIR), c.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        order = sorted(names)
        assert sorted(tuple(plain(r[x]) for x in order) for r in got.collect()) == sorted(tuple(plain(r[names.index(x)]) for x in order) for r in want.fetchall()), name


def test_columns_that_clash(spark):
    """Extra columns with the names that the operators use themselves change nothing."""
    docs, labels = toxic_docs()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    clash = df
    for name in ("toxic", "held_out", "score", "h", "l_id", "words", "lang_pred", "predicted"):
        clash = clash.withColumn(name, F.lit("x"))
    assert sorted(T.toxicity(clash, lab.withColumn("h", F.lit(1)).withColumn("text", F.lit("t"))).collect()) == sorted(T.toxicity(df, lab).collect())
    known = spark.createDataFrame([r[:3] for r in language_docs()], "doc_id long, text string, lang string")
    assert sorted(L.identify(known.withColumn("held_out", F.lit(1)).withColumn("score", F.lit(2)).withColumn("gram", F.lit(3))).collect()) == sorted(L.identify(known).collect())
    copies = frame(spark, [sentence(1, 90), sentence(1, 90) + " end", sentence(2, 90)])
    for name in ("__fp", "__keys", "fp", "candidates", "of_text", "row", "first_id", "id", "keys"):
        copies = copies.withColumn(name, F.lit("x"))
    kept = S.drop_similar(copies)
    assert kept.columns == copies.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [0, 2]


def test_steps_are_released(spark):
    step = C.materialize(spark.range(5).toDF("id"), "kept")
    path = step.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and C.release(spark) > 0 and not os.path.isdir(path) and C.release(spark) == 0


def test_hot_keys_join_as_others(spark):
    """A key of 300 of 420 rows, and keys that the other side lacks."""
    many = spark.createDataFrame([(0 if i < 300 else i, i) for i in range(420)], "k long, n long")
    one = spark.createDataFrame([(k, k * 2) for k in [0, *range(300, 420, 2)]], "k long, v long")
    assert sorted(C.join_one(many, one, "k").select("k", "n", "v").collect()) == sorted(many.join(one, "k").select("k", "n", "v").collect())
