"""Every registered query against its SQL, and properties of the plans."""

import math

import duckdb
import pytest
from conftest import SMALLEST

import __spark_entry__ as entry
from siltstone.plans.oracles import oracle_sql
from siltstone.plans.queries import QUERIES

SQL = oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
APPROXIMATE = {"knn_approximate"}
STREAMING = {"stream_rule_parity"}
SEARCHING = {
    "knn_top3", "knn_cosine", "knn_issues", "knn_filtered", "knn_batch", "code_with_context", "issues_with_context",
    "answer_questions", "chat_memory_confidence", "retrieval_gate", "context_text", "knn_indexed",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALLEST}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(plain(row[i]) for i in at) for row in rows), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) | APPROXIMATE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - APPROXIMATE))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SMALLEST)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    wanted = sorted(columns)
    assert sorted(frame.columns) == wanted
    assert rows_of(frame.collect(), frame.columns, wanted) == rows_of(cursor.fetchall(), columns, wanted)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in SEARCHING:
        assert "Python" not in plan and "InPandas" not in plan


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.category for r in rows} == {"security", "complexity", "documentation", "duplication"}


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["issues_by_severity"](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_comment" not in plan
    plan = QUERIES["secret_scan_documents"](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "PushedFilters: [IsNotNull(text), StringContains(text,=)]" in plan
