"""Every query that has SQL against DuckDB on the smallest tables; the others must run and have rows of a stable schema."""

import datetime
import math

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
#: On the smallest tables no fold has enough rows.
LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(round(x, 7) + 0.0)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return repr(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == names
    order = [found.columns.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert mine == theirs


def close(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(close, x)) if isinstance(x, list) else x




@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_without_sql(spark, name):
    """Rows, finite numbers, and the same ones however the shuffles are cut."""
    rows = catalog.queries()[name](spark, LARGER).collect()
    assert rows
    for r in rows:
        assert all(math.isfinite(x) for x in r if isinstance(x, float))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = catalog.queries()[name](spark, LARGER).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    mine, theirs = (sorted(str(tuple(map(close, r))) for r in x) for x in (rows, again))
    assert mine == theirs
