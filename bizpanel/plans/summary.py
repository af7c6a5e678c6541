"""The stored monthly customer summary, kept up to date year by year.

Beside the summary lies what it was built from: a signature of every partition of the headers and lines, and one of the
item master. A refresh compares them with the files as they are now and rebuilds the years that depend on what
changed, replacing their partitions. Lines take their customer from a header that may lie in another year, so it is
also kept which years of lines hang on which years of headers. What was built is recorded last: a refresh that fails is
simply made again.

Years are rebuilt in turns, each of which writes its partitions and gives up the files of its shuffles. So a rebuild of
all years needs room for one turn beside the tables, not for the sums of the whole history.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizpanel.operators.lineage import releasing
from bizpanel.plans.sales import LINE_YEAR, customer_monthly_summary, of_years
from bizpanel.sources import changes, versions
from bizpanel.sources.schema import HEADER_YEAR
from bizpanel.sources.tables import Tables, drop_partition, partition_files, write_table

SUMMARY = "customer_monthly_summary"
SUMMARY_YEAR = "summary_year"
STATE = "customer_monthly_state"
#: ``signature`` rows have a source and year; ``hangs_on`` rows the year of lines, and of the headers they belong to.
_STATE = "kind string, source string, year int, on_year int, signature long"
#: Bytes of stored headers and lines that are rebuilt in one turn, or as many as make this many turns. Each turn reads
#: the headers' ids and customers again.
TURN_BYTES = 64 << 20
TURNS = 8


def source_signatures(spark: SparkSession, root: str) -> DataFrame:
    """Signatures of all that the summary is built from."""
    return (
        changes.signatures(spark, f"{root}/sales_header", "header", HEADER_YEAR)
        .unionByName(changes.signatures(spark, f"{root}/sales_line", "line", LINE_YEAR))
        .unionByName(changes.signatures(spark, f"{root}/item_master", "item"))
    )


def _hangs_on(lines: DataFrame, header: DataFrame) -> DataFrame:
    """Which years of lines take customers from which years of headers."""
    per_invoice = lines.select("int_id", F.col(LINE_YEAR).alias("year")).distinct()
    dated = header.select(F.col("internal_id").alias("int_id"), F.col(HEADER_YEAR).alias("on_year"))
    return per_invoice.join(dated, "int_id").select("year", "on_year").distinct()


def _years(df: DataFrame, name: str = "year") -> set[int | None]:
    return {r[0] for r in df.select(name).distinct().collect()}


def _among(name: str, years: Collection[int | None]) -> Column:
    test = F.coalesce(F.col(name).isin(sorted(y for y in years if y is not None)), F.lit(False))
    return test | F.col(name).isNull() if None in years else test


def _state(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """What the stored summary was built from, and the number of that record."""
    path = f"{root}/{STATE}"
    last = versions.current(spark, path)
    return (versions.read(spark, path), last.number) if last else (spark.createDataFrame([], _STATE), 0)


def _stale(tables: Tables, state: DataFrame, now: DataFrame) -> set[int | None]:
    signed = state.filter("kind = 'signature'").select("source", "year", "signature")
    found = changes.changed(signed, now)
    if any(source == "item" for source, _ in found):
        return _years(now.unionByName(signed).filter("source <> 'item'"))
    years = {year for _, year in found}
    headers = {year for source, year in found if source == "header"}
    if headers:
        years |= _years(state.filter("kind = 'hangs_on'").filter(_among("on_year", headers)))
        changed_headers = of_years(tables.sales_header, HEADER_YEAR, headers)
        years |= _years(_hangs_on(tables.sales_line, changed_headers))
    return years


def stale_years(spark: SparkSession, root: str) -> set[int | None]:
    """Years of the summary that may differ from what a rebuild would give.

    All years if an item changed. Otherwise the years of changed lines, the years of changed headers, and the years
    of lines that belong, or belonged, to a changed header.
    """
    tables = Tables.from_parquet(spark, root, closed=False)
    return _stale(tables, _state(spark, root)[0], source_signatures(spark, root))


def _turns(sizes: Mapping[int | None, int]) -> list[set[int | None]]:
    """Years in groups of at most TURN_BYTES, or of the share of one of TURNS; a larger year is a group of its own."""
    most = max(TURN_BYTES, sum(sizes.values()) // TURNS)
    groups: list[set[int | None]] = []
    room = -1
    for year, size in sorted(sizes.items(), key=lambda s: (s[0] is not None, s[0] or 0)):
        if size > room:
            groups.append(set())
            room = most
        groups[-1].add(year)
        room -= size
    return groups


def _rebuild(
    tables: Tables, root: str, names: DataFrame | None, turn: Collection[int | None], years: Collection[int | None]
) -> None:
    """Replace the summary of the years of a turn; those without rows go."""
    spark = tables.spark
    before = {year: partition_files(spark, root, SUMMARY, SUMMARY_YEAR, year) for year in turn}
    write_table(customer_monthly_summary(tables, names, turn, among=years), root, SUMMARY)
    for year, files in before.items():
        if partition_files(spark, root, SUMMARY, SUMMARY_YEAR, year) == files:
            drop_partition(spark, root, SUMMARY, SUMMARY_YEAR, year)


def refresh_summary(
    spark: SparkSession, root: str, names: DataFrame | None = None
) -> set[int | None]:
    """Bring the stored summary up to date; the years that were rebuilt."""
    with releasing(spark):
        return _refresh(spark, root, names)


def _refresh(spark: SparkSession, root: str, names: DataFrame | None) -> set[int | None]:
    tables = Tables.from_parquet(spark, root, closed=False)
    state, number = _state(spark, root)
    # one row per partition, taken before the data are read: what changes meanwhile is stale next time
    now = spark.createDataFrame(source_signatures(spark, root).collect(), changes.SIGNATURES)
    years = _stale(tables, state, now)
    if not years:
        return years
    stored = (("sales_header", HEADER_YEAR), ("sales_line", LINE_YEAR))
    sizes = {y: sum(sum(partition_files(spark, root, t, c, y).values()) for t, c in stored) for y in years}
    for turn in _turns(sizes):
        _rebuild(tables, root, names, turn, years)
    hanging = _hangs_on(of_years(tables.sales_line, LINE_YEAR, years), tables.sales_header)
    others = state.filter("kind = 'hangs_on'").filter(~_among("year", years))
    record = (
        now.withColumn("kind", F.lit("signature"))
        .unionByName(hanging.withColumn("kind", F.lit("hangs_on")), allowMissingColumns=True)
        .unionByName(others, allowMissingColumns=True)
    )
    record = record.select("kind", "source", "year", F.col("on_year").cast("int").alias("on_year"), "signature")
    versions.publish(record, f"{root}/{STATE}", made_from=number)
    return years
