"""The driver's queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftmap.plans import answers, testdata

QUERIES = testdata.queries() | answers.queries()
ORACLE = testdata.oracle_sql() | answers.oracle_sql()

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    made = sql.execute(ORACLE[name])
    assert got == rows([c[0] for c in made.description], made.fetchall())


def test_entry(spark):
    assert entry.entry(spark).first()["text"].endswith(" tokens]")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_tries_are_not_dealt_out(spark):
    """An import's tries are told in its row, and an order is dealt out once."""
    plan = testdata.import_candidates(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Exchange hashpartitioning(l_orderkey" in plan
    assert all("l_partkey" not in x.split("(", 1)[1] for x in plan.split("\n") if "Exchange hashpartitioning(l_orderkey" in x)


def test_a_tree_is_read_once(spark):
    """A scanned file is parsed as it is read, beside its name and size."""
    plan = testdata.tree_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan


def test_context_makes_the_edges_once(spark, monkeypatch):
    """Order lines are read for the edges alone, not again for each way and for the scores."""
    from weftmap.operators import rank

    given = []
    scores = spark.createDataFrame([(testdata.seed(), 0.5)], "file_path string, score double")
    monkeypatch.setattr(rank, "pagerank", lambda files, edges, **how: (given.append(edges), rank.Ranked(scores, 20, False))[1])
    plan = testdata.context_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "l_orderkey" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
