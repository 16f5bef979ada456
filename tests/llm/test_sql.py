import duckdb
import pytest

from cuelattice.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    frame = QUERIES[name](spark, SF)
    assert sorted(map(tuple, frame.select(columns).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_gives_a_row_for_each_document_or_conversation(spark, name):
    got = QUERIES[name](spark, SF)
    table, key, more = ("conversations", "conv_id", 1) if name.startswith("op10_") else ("documents", "doc_id", 0)
    want = spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count() + more
    assert got.select(key).distinct().count() == got.count() == want
