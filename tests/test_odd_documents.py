"""roundtrip_documents against its SQL where texts are null or empty."""

import duckdb

from incognita.plans import queries


def test_null_and_empty_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "Ab a@mail1.example.com\n4400430000000008 x"), (4, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.roundtrip_documents(spark, str(tmp_path)).select("doc_id", "n_email", "n_card", "roundtrip_ok")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(queries.O_ROUNDTRIP).fetchall())
