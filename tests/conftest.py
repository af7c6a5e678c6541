from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from bizpanel.session import build_session
from bizpanel.sources.schema import SCHEMAS, columns
from bizpanel.sources.tables import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session(
        8,
        "bizpanel-tests",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.sql.maxMetadataStringLength": "2000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def _value(value: object, kind: str) -> object:
    if value is None:
        return None
    if kind.startswith("decimal"):
        return Decimal(str(value))
    if kind == "date" and isinstance(value, str):
        return dt.date.fromisoformat(value)
    return value


@pytest.fixture(scope="session")
def make_tables(spark):
    """Tables from rows given as dicts; columns not named are NULL, tables not named empty."""

    def build(**rows: list[dict]) -> Tables:
        loaders = {}
        for name in SCHEMAS:
            declared = columns(name)
            data = [
                tuple(_value(row.get(c), kind) for c, kind in declared)
                for row in rows.get(name, [])
            ]
            loaders[name] = lambda n=name, d=data: spark.createDataFrame(d, SCHEMAS[n])
        return Tables(spark, loaders)

    return build


@pytest.fixture
def only():
    """The single row of a frame as a dict."""

    def read(df) -> dict:
        rows = df.collect()
        assert len(rows) == 1
        return rows[0].asDict()

    return read
