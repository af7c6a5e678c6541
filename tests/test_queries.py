"""Every registered query against its SQL, on the smallest test tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from bizpanel.checks import all_checks
from tests.conftest import SMALL

QUERIES = {name: check.run for name, check in all_checks().items()}
SQL = {name: check.sql for name, check in all_checks().items()}
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
# A cross join or a nested loop compares all pairs; Python workers leave the JVM.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "BatchEvalPython")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def _row(row, names, order):
    return repr([0.0 if row[names.index(c)] == 0.0 else row[names.index(c)] for c in order])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in UNWANTED if word in plan]
    relation = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    ours = Counter(_row(tuple(r), df.columns, order) for r in rows)
    theirs = Counter(_row(r, relation.columns, order) for r in relation.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert len(contract.entry(spark).collect()) == 1


def test_every_query_has_sql():
    assert all(SQL.values())
    assert set(QUERIES) <= set(contract.queries())
    assert {name: contract.oracle_sql()[name] for name in QUERIES} == SQL
