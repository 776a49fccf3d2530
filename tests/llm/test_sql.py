"""The registered SQL of this subpackage against its queries, on the same tables."""

import duckdb
import pytest
from test_queries import ordered

from planeworks.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert ordered(df.select(*want.columns).collect()) == ordered(want.fetchall())
