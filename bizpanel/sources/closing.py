"""Closing years of the ledger: balances carried forward, and a ledger that starts from them.

The balances of all closed years are one row for each account, currency, bank and vendor, in the ledger's own shape and
dated on the last day before the first open year. They are a table of snapshots beside the ledger, and each
snapshot says before which year it is closed. Closing further years adds their lines to the balances of the last
snapshot: closed years are read once, ever. The lines themselves stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizpanel.sources import versions
from bizpanel.sources.schema import SCHEMAS, YEAR_PARTITIONS

LEDGER = "journal_line"
BALANCES = "journal_closed"
YEAR_COLUMN = YEAR_PARTITIONS[LEDGER][0]
KEYS = ("account", "line_currency", "bank", "vendor")
AMOUNTS = ("debit_book", "credit_book", "debit_txn", "credit_txn")
_SUM = "decimal(28,5)"


def _first_day(year: int) -> Column:
    return F.make_date(F.lit(year), F.lit(1), F.lit(1))


def carried_forward(lines: DataFrame, before: int) -> DataFrame:
    """Lines and earlier balances as one row per key, dated on the last day before ``before``."""
    return (
        lines.groupBy(*KEYS)
        .agg(*[F.sum(a).cast(_SUM).alias(a) for a in AMOUNTS])
        .withColumn("journal_date", F.make_date(F.lit(before - 1), F.lit(12), F.lit(31)))
    )


def _lines(spark: SparkSession, root: str, first: int | None, before: int | None) -> DataFrame:
    """Ledger lines from the year ``first`` on and before the year ``before``; only their partitions are read.

    Lines without date belong to no year: they are in no balance and always with the open lines.
    """
    schema = f"{SCHEMAS[LEDGER]}, {YEAR_COLUMN} int"
    lines = spark.read.schema(schema).parquet(f"{root}/{LEDGER}")
    year, date = F.col(YEAR_COLUMN), F.col("journal_date")
    if before is not None:
        lines = lines.filter((year < before) & (date < _first_day(before)))
        return lines if first is None else lines.filter((year >= first) & (date >= _first_day(first)))
    if first is not None:
        lines = lines.filter(((year >= first) & (date >= _first_day(first))) | year.isNull())
    return lines


def closed_before(spark: SparkSession, root: str) -> int | None:
    """The first open year; None if no year was closed."""
    last = versions.current(spark, f"{root}/{BALANCES}")
    return None if last is None else int(last.properties["before"])


def close_years(spark: SparkSession, root: str, before: int) -> versions.Version:
    """Close all years before ``before``. Years that are closed already are not read again."""
    path = f"{root}/{BALANCES}"
    last = versions.current(spark, path)
    since = None if last is None else int(last.properties["before"])
    if since is not None and before <= since:
        raise ValueError(f"all years before {since} are closed")
    lines = _lines(spark, root, since, before)
    if last is not None:
        lines = lines.unionByName(versions.read(spark, path), allowMissingColumns=True)
    return versions.publish(
        carried_forward(lines, before), path, {"before": before}, made_from=last.number if last else 0
    )


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Balances of the closed years and the lines of the open ones, with the ledger's columns and its partition."""
    before = closed_before(spark, root)
    lines = _lines(spark, root, before, None)
    if before is None:
        return lines
    balances = versions.read(spark, f"{root}/{BALANCES}").withColumn(YEAR_COLUMN, F.lit(before - 1))
    return lines.unionByName(balances, allowMissingColumns=True)
