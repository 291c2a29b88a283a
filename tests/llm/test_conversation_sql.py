import duckdb
import pytest

from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["op11_repair", "op13_trie"])
def test_the_query_gives_the_rows_of_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    df = QUERIES[name](spark, folder)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(cursor.fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == want
    assert want
