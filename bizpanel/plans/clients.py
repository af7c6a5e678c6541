"""Clients who charged cards, counted once over any months, from stored monthly bitmaps.

``refresh_client_months`` keeps the bitmaps beside the charging history: a year is built again only when its partition's files
changed. Reports then read months of bitmaps instead of the history. All counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizpanel.operators.bitmaps import BITMAP, BUCKET, bitmaps, distinct_where, merge_bitmaps
from bizpanel.operators.lineage import cut
from bizpanel.operators.period import Period, quarter_of
from bizpanel.sources import changes, versions
from bizpanel.sources.schema import YEAR_PARTITIONS
from bizpanel.sources.tables import Tables, drop_partition, write_table

CLIENT_MONTHS = "client_months"
STATE = "client_months_state"
CHARGING_YEAR = YEAR_PARTITIONS["charging"][0]
_MONTH = (CHARGING_YEAR, "charging_month")


def client_months(charging: DataFrame) -> DataFrame:
    """Bitmaps of the clients of each month."""
    return bitmaps(charging, _MONTH, "client_id")


def _sides(year: int) -> list[Column]:
    return [
        distinct_where(F.col(CHARGING_YEAR) == y).alias(f"{side}_active_clients")
        for side, y in (("cy", year), ("py", year - 1))
    ]


def _two_years(months: DataFrame, year: int) -> DataFrame:
    return months.filter(F.col(CHARGING_YEAR).isin(year, year - 1))


def active_clients(months: DataFrame, period: Period) -> DataFrame:
    """Clients of the period's months and of the same months a year before, each counted once."""
    chosen = _two_years(months, period.year).filter(period.month_number_filter(F.col("charging_month")))
    return merge_bitmaps(chosen, [CHARGING_YEAR]).agg(*_sides(period.year))


def active_clients_by_quarter(months: DataFrame, year: int) -> DataFrame:
    """Clients of each quarter, each counted once in a quarter."""
    quarter = quarter_of(F.col("charging_month")).alias("quarter")
    merged = merge_bitmaps(_two_years(months, year), [CHARGING_YEAR, quarter])
    return merged.groupBy("quarter").agg(*_sides(year))


def active_clients_to_date(months: DataFrame, year: int) -> DataFrame:
    """For each month from the first with clients, those from January up to it, each counted once, in both years."""
    until = F.explode(F.sequence(F.col("charging_month"), F.lit(12))).alias("month")
    opened = _two_years(months, year).filter(F.col("charging_month").between(1, 12))
    spread = opened.select(CHARGING_YEAR, until, BUCKET, BITMAP)
    return merge_bitmaps(spread, [CHARGING_YEAR, "month"]).groupBy("month").agg(*_sides(year))


def refresh_client_months(spark: SparkSession, root: str) -> set[int | None]:
    """Bring the stored bitmaps up to date with the stored charging history; the years that were rebuilt.

    What they were built from is recorded last, so a refresh that fails is simply made again.
    """
    path = f"{root}/{STATE}"
    last = versions.current(spark, path)
    before = versions.read(spark, path) if last else spark.createDataFrame([], changes.SIGNATURES)
    # one row per partition, taken before the data are read: what changes meanwhile is stale next time
    now = changes.signatures(spark, f"{root}/charging", "charging", CHARGING_YEAR)
    now = spark.createDataFrame(now.collect(), changes.SIGNATURES)
    years = {year for _, year in changes.changed(before, now)}
    if not years:
        return years
    tables = Tables.from_parquet(spark, root, closed=False)
    known = sorted(y for y in years if y is not None)
    of_years = F.coalesce(F.col(CHARGING_YEAR).isin(known), F.lit(False))
    if None in years:
        of_years = of_years | F.col(CHARGING_YEAR).isNull()
    built = cut(client_months(tables.charging.filter(of_years)))
    write_table(built, root, CLIENT_MONTHS)
    for year in years - {r[0] for r in built.select(CHARGING_YEAR).distinct().collect()}:
        drop_partition(spark, root, CLIENT_MONTHS, CHARGING_YEAR, year)
    versions.publish(now, path, made_from=last.number if last else 0)
    return years
