"""Every named query against its SQL on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries as named

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if hasattr(value, "isoformat") else value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns = sorted(result.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in result.collect()]
    sql = entry.oracle_sql()[name]
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(_plain(r[i]) for i in order) for r in answer.fetchall()]
    assert _sorted(rows) == _sorted(expected)


def test_every_query_has_sql():
    assert set(named.QUERIES) == set(named.ORACLES) and set(named.QUERIES) <= set(entry.queries())


def test_entry_returns_metrics(spark):
    row = entry.entry(spark).first()
    assert row["total_requests"] == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
