"""Every registered query against its SQL on the smallest tables; those without SQL must run."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plumage.plans import all_queries
from verify import rows

NAMES = sorted(all_queries().queries)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, con):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in entry.oracle_sql():
        r = con.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(r.columns)
        assert got == rows(r.columns, r.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
