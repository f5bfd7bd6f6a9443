"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from leafmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = registry.queries()[name](spark, SF)
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in ours.columns]
    a = sorted(tuple(map(str, map(plain, r))) for r in ours.collect())
    b = sorted(tuple(str(plain(r[i])) for i in at) for r in theirs.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
