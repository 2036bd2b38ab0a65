"""Every registered query against its SQL, on the small tables."""

import duckdb
import pytest

from incognita.plans import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, FOLDER)
    expected = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    got = sorted(str([plain(row[c]) for c in columns]) for row in found.collect())
    want = sorted(str([plain(v) for v in row]) for row in expected.fetchall())
    assert got == want
