"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import duckdb
import pytest

from engram.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


def norm(rows, columns, names):
    order = [columns.index(n) for n in names]
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert norm(rows, df.columns, sorted(columns)) == norm(found.fetchall(), columns, sorted(columns))


def test_plans_push_filters_and_prune(spark, data):
    from engram.operators import access
    from engram.sources import fixtures

    plan = access.list_by_entity(fixtures.memories(spark, data), "user_7", 5).select("memory_id", "created_at")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan.replace("string,", "string,")


def test_similarity_needs_no_shuffle_of_rows(spark, data):
    from engram.operators import retrieve
    from engram.sources import fixtures

    plan = retrieve.similarity(fixtures.memories(spark, data, vectors=True), [0.1] * 64, 5).select("memory_id", "relevance")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange hashpartitioning" not in plan


def test_ingest_propositions_counts_blank_and_null_texts(spark, tmp_path):
    rows = [("a", "x"), ("a", "x "), ("a", "　x "), ("a", "x\t"), ("a", " "), ("a", ""), ("a", None), ("b", None), ("c", " "), (None, "y"), (None, "z")]
    spark.createDataFrame(rows, "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.execute(registry.oracle_sql()["ingest_propositions"]).fetchall()
    got = [tuple(r) for r in registry.queries()["ingest_propositions"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and ("b", 0) in got


def test_edges_equal_their_sql_in_tasks_of_few_rows(spark, data, duck):
    """The view of the edges takes tasks by the rows of the table, and holds no texts while it orders them."""
    from engram.sources import fixtures

    e = fixtures.edges(spark, data, 100)
    assert e.select("src").where("edge_type = 'followed_by'").rdd.getNumPartitions() >= 10
    assert norm([tuple(r) for r in e.collect()], e.columns, e.columns) == norm(duck.execute(f"with {fixtures.SQL_E} select src, dst, edge_type, confidence, ts_us from edges").fetchall(), e.columns, e.columns)
