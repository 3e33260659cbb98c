"""Every query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from quillon import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    r = duck.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
