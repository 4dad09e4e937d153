"""The column queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from sparquarry.plans import columns

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(columns.QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    df = columns.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    want = sorted(sql.execute(f"SELECT {', '.join(names)} FROM ({columns.ORACLES[name]})").fetchall(), key=repr)
    assert got == want and got
