from __future__ import annotations

import os

import duckdb
import pytest

from bizpanel.checks.mapping import TABLES
from bizpanel.sources import profile, requests
from bizpanel.sources.schema import columns
from bizpanel.sources.standin import MAPPINGS, standin_tables
from bizpanel.sources.tables import Tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def _text(value):
    if value is None:
        return None
    if isinstance(value, str):
        return value
    try:
        return round(float(value), 5)
    except TypeError:
        return str(value)


@pytest.mark.parametrize("name", sorted(MAPPINGS))
def test_both_mappings_agree(spark, duck, name):
    names = [c for c, _ in columns(name)]
    ours = [tuple(map(_text, r)) for r in standin_tables(spark, SMALL)[name].select(*names).collect()]
    theirs = duck.sql(f"SELECT {', '.join(names)} FROM ({TABLES[name]})").fetchall()
    assert sorted(map(str, ours)) == sorted(map(str, (tuple(map(_text, r)) for r in theirs)))


def test_tables_by_name(spark, make_tables):
    tables = make_tables(charging=[{"client_id": 1}])
    assert tables.charging.count() == 1 and "charging" in tables
    assert tables.charging is tables["charging"]
    swapped = tables.replace(charging=tables.charging.limit(0))
    assert swapped.charging.count() == 0 and tables.charging.count() == 1
    with pytest.raises(AttributeError):
        tables.nothing
    tables.charging.createOrReplaceTempView("history_of_charging")
    named = Tables.from_catalog(spark, {"charging": "history_of_charging"})
    assert named.charging.count() == 1 and named.names == ["charging"]


def test_catalog_profile(spark):
    spark.range(4).createOrReplaceTempView("present_table")
    rows = profile.catalog_profile(spark, ["present_table", "missing_table"]).collect()
    assert sorted((r.table_name, r.table_exists, r.row_count) for r in rows) == [
        ("missing_table", False, None),
        ("present_table", True, 4),
    ]


def test_schema_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int not null, b string")
    rows = [tuple(r) for r in profile.schema_profile(df).orderBy("position").collect()]
    assert rows == [(1, "a", "int", False, 0), (2, "b", "string", True, 1)]


def test_broken_requests_give_nulls(spark):
    rows = [
        (1, '{"Period":"quarterly","Months":"","Quarter":2,"Year":2026}'),
        (2, '{"Period":"quart'),
        (3, '{"Period":"monthly","Months":"6","Quarter":0,"Year":2026,"CustomerType":"Export"}'),
    ]
    df = spark.createDataFrame(rows, "id int, doc string")
    typed = requests.requests(df, "doc").drop("doc")
    assert [tuple(r) for r in typed.orderBy("id").collect()] == [
        (1, "quarterly", "", 2, 2026, None),
        (2, None, None, None, None, None),
        (3, "monthly", "6", 0, 2026, "Export"),
    ]
    months = requests.month_rows(requests.requests(df, "doc")).orderBy("id", "month")
    assert [(r.id, r.month) for r in months.collect()] == [(1, 4), (1, 5), (1, 6), (3, 6)]
