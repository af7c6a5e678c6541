"""Registration of checked queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizpanel.checks.mapping import finish
from bizpanel.sources.standin import standin_tables
from bizpanel.sources.tables import Tables

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Check:
    """A query over the business tables, with the SQL that must give the same rows."""

    name: str
    build: Build
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return plain(self.build(standin_tables(spark, folder)))


CHECKS: dict[str, Check] = {}


def check(
    name: str,
    sql: str | None = None,
    money: str = "",
    ints: str = "",
    longs: str = "",
    dates: str = "",
) -> Callable[[Build], Build]:
    """Register a query. The column lists name the final types of SQL columns."""

    def register(build: Build) -> Build:
        if name in CHECKS:
            raise ValueError(f"query {name!r} is registered twice")
        text = None if sql is None else finish(sql, money, ints, longs, dates)
        CHECKS[name] = Check(name, build, text)
        return build

    return register


def count() -> Column:
    """COUNT(*)."""
    return F.count(F.lit(1))


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles with two decimals, dates as text, so that engines agree."""
    columns = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, T.DecimalType):
            columns.append(f"round(CAST({name} AS DOUBLE), 2) AS {name}")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            columns.append(f"CAST({name} AS STRING) AS {name}")
        else:
            columns.append(name)
    return df.selectExpr(*columns)
