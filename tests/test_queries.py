"""Every registered query of this package against its SQL on the smallest tables."""

import math
import os

import pytest
from sampleloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, str | list):
        return str(x)
    return repr(round(float(x), 6))


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name].run(spark, SF)
    result = con.execute(QUERIES[name].sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(value(r[c]) for c in sorted(columns)) for r in df.collect())
    want = sorted(tuple(value(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0


def test_entry_and_queries_can_be_read_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
