import duckdb
import pytest

from wayfloor.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = con.sql(oracle_sql()[name])
    columns = list(rel.columns)
    df = queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(map(tuple, rel.fetchall()))
