"""Every registered query with SQL gives the SQL's rows on the driver's small tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def normal(v):
    import decimal
    import math

    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    got = sorted((tuple(normal(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    expected = sorted((tuple(normal(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(expected)
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
