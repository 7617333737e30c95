"""The contract queries that SQL can express against DuckDB on the same files."""

import duckdb
import pytest

from textloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(name, spark, data):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    result = c.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    made = queries()[name](spark, data)
    assert sorted(made.columns) == sorted(columns)
    assert sorted(made.select(*columns).collect(), key=repr) == sorted(result.fetchall(), key=repr)
