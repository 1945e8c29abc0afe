"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BASE = {k: v for k, v in entry.oracle_sql().items() if k in entry.plans.QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.4f}".replace("-0.0000", "0.0000")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


@pytest.mark.parametrize("name", sorted(BASE))
def test_query(spark, duck, name):
    got = entry.plans.QUERIES[name](spark, DIR)
    want = duck.execute(BASE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert a == b
