from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

# One query of each family; tools/check.py compares all of them.
SAMPLE = ["decoded_messages", "velocity_lagged_day", "features", "case_reviews", "confirmed_cases", "similar_cases",
          "retrieved_contexts", "transaction_history", "upserted_customers", "audit_violations", "running_auc",
          "stratified_split", "top_attributions", "follow_up_prompts", "review_payloads", "audit_decisions",
          "agent_prompts", "decision_records", "orphan_report", "online_features"]


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_entry_counts_routes(spark):
    rows = entry.entry(spark).collect()
    assert {r["route"] for r in rows} <= {"fraud-alerts", "human-review", "approved-transactions"}
    assert sum(r["decisions"] for r in rows) == 1000


def test_answers_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 75
