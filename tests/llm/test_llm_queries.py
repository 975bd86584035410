"""The registered queries of the subpackage on the smallest tables, with their SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plumage.llm.queries import reg
from verify import rows


@pytest.mark.parametrize("name", sorted(reg.queries))
def test_query(name, spark, sf):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name.endswith("_found"):
        assert len(got) == len(set(got))
    if name in reg.sql:
        c = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        r = c.sql(reg.sql[name])
        assert got == rows(r.columns, r.fetchall())
