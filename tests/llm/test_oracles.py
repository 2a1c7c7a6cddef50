"""Registered corpus queries against their SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest

from recordloom.llm.queries import oracle_sql, queries
from tests.records.test_oracles import table


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries()[name](spark, small)
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = table(df.columns, df.collect())
    assert got == table(columns, result.fetchall()) and got
