"""Every registered query against its SQL twin on the same tables."""
import math

import duckdb
import pytest

import __spark_entry__
from workload import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
CROSSING = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="session")
def duck(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return connection


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in records)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in CROSSING if operator in plan]
    result = duck.execute(ORACLES[name])
    expected_names = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(expected_names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(expected_names, expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
