"""The queries that have SQL against it, on the small tables."""

import duckdb
import pytest

from incognita.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found, expected = queries.QUERIES[name](spark, FOLDER), con.execute(queries.ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(str([plain(row[c]) for c in columns]) for row in found.collect()) == sorted(str([plain(v) for v in row]) for row in expected.fetchall())
