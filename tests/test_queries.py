"""Every query that has SQL against DuckDB, on the smallest tables."""

import collections
import decimal

import duckdb
import pytest

from lakequill.plans.queries import ORACLE, QUERIES
from lakequill.sources.tables import NAMES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return "null" if v != v else round(float(v), 6)
    return "null" if v is None else v if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        assert collections.Counter(tuple(map(plain, r)) for r in rows) == collections.Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
