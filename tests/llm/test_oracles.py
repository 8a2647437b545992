"""The corpus queries that SQL expresses, against their DuckDB oracles."""

import duckdb
import pytest

from brinewell.llm import queries as llm
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(llm.ORACLES[name])
    columns = [d[0] for d in r.description]
    df = llm.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(r.fetchall())
