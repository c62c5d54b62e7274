"""The queries that SQL can express, against it."""

import duckdb
import pytest

from weftmap.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "clicks", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    made = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in made.description)
    place = [[c[0] for c in made.description].index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in place) for r in made.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect()) == want
