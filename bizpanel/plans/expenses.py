"""Expenses by period: per account, per parent segment, full detail, shares."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.classify import expense_badge
from bizpanel.functions.numbers import or_zero, pct_of
from bizpanel.operators.aggregates import rollup_parent, share_of_parent
from bizpanel.operators.joins import attach_scalar, with_parent
from bizpanel.operators.lists import Lists
from bizpanel.operators.period import Period, prune_years
from bizpanel.plans import ledger
from bizpanel.sources.schema import HEADER_YEAR
from bizpanel.sources.tables import Tables

DETAIL_KEYS = (
    "account",
    "account_description",
    "segment9",
    "segment_description",
    "parent_value",
    "parent_description",
)


def expense_base(journal: DataFrame, period: Period) -> DataFrame:
    """Expense amount per account and segment, summed before any dimension is joined."""
    of_year = prune_years(journal, "journal_year", period.year, period.year)
    return (
        of_year.filter(ledger.expense_rows(period))
        .groupBy("account", "segment9")
        .agg(F.sum(ledger.book_balance()).alias("total_amount"))
    )


def expense_detail(base: DataFrame, tables: Tables) -> DataFrame:
    """Amount per account, segment and parent segment, with their descriptions."""
    named = with_parent(
        ledger.with_account_name(base, tables.accounts_master),
        tables.segments_master,
        fixed.EXPENSE_SEGMENT_ID,
    )
    return named.groupBy(*DETAIL_KEYS).agg(F.sum("total_amount").alias("total_amount"))


def expense_accounts(base: DataFrame, accounts: DataFrame) -> DataFrame:
    """Amount per account with its description."""
    by_account = base.groupBy("account").agg(F.sum("total_amount").alias("total_amount"))
    return (
        ledger.with_account_name(by_account, accounts)
        .groupBy("account", "account_description")
        .agg(F.sum("total_amount").alias("total_amount"))
    )


def total_sales(header: DataFrame, period: Period) -> DataFrame:
    """Sales of the same period by invoice *date*; 0 when there are none."""
    year = prune_years(header, HEADER_YEAR, period.year, period.year)
    return year.filter(period.date_filter(F.col("invoice_date"))).agg(
        or_zero(F.sum(F.col("total_taxable_amount") * F.col("exchange_rate")))
        .cast("decimal(18,2)")
        .alias("total_sales_amount")
    )


def expenses_period(tables: Tables, period: Period) -> Lists:
    """The expense report: ``accounts``, ``parents`` and ``detail``."""
    tables.require_open(period.year)
    base = expense_base(tables.journal_line, period)

    def accounts() -> DataFrame:
        return attach_scalar(
            expense_accounts(base, tables.accounts_master),
            total_sales(tables.sales_header, period),
            "total_sales_amount",
        )

    def parents() -> DataFrame:
        detail = expense_detail(base, tables)
        return rollup_parent(detail, "parent_description", "total_amount").orderBy(
            F.col("total_amount").desc_nulls_last(), F.col("parent_description").asc_nulls_first()
        )

    def detail() -> DataFrame:
        return expense_detail(base, tables).orderBy(
            F.col("parent_description").asc_nulls_first(),
            F.col("total_amount").desc_nulls_last(),
            "account",
            F.col("segment9").asc_nulls_first(),
        )

    return Lists({"accounts": accounts, "parents": parents, "detail": detail})


def parent_name() -> Column:
    named = F.when(F.col("parent_description") != "", F.col("parent_description"))
    return F.coalesce(named, F.lit("Other"))


def expense_drill(detail: DataFrame) -> DataFrame:
    """Totals per account and parent, segments without a parent under ``Other``."""
    return detail.groupBy("account", parent_name().alias("parent")).agg(
        F.sum(or_zero(F.col("total_amount"))).alias("group_total"),
        F.count(F.lit(1)).alias("segments"),
    )


def expense_share(report: Mapping[str, DataFrame]) -> Lists:
    """Shares of the expense report.

    ``parents`` of each account total, ``segments`` of their parent total, and
    ``accounts`` against sales, with a closing row for all accounts.
    """

    def parents() -> DataFrame:
        drill = expense_drill(report["detail"])
        return share_of_parent(drill, "group_total", ["account"], "share_pct")

    def segments() -> DataFrame:
        detail = report["detail"].withColumn("parent", parent_name())
        shares = share_of_parent(detail, "total_amount", ["account", "parent"], "share_pct")
        return shares.select(
            "account", "parent", "segment9", "segment_description", "total_amount", "share_pct"
        )

    def accounts() -> DataFrame:
        rows = report["accounts"]
        total = rows.agg(
            F.lit("Total").alias("account"),
            F.lit("Total Expenses").alias("account_description"),
            or_zero(F.sum("total_amount")).alias("total_amount"),
            F.max("total_sales_amount").alias("total_sales_amount"),
        )
        ratio = pct_of(F.col("total_amount"), F.col("total_sales_amount"))
        return (
            rows.unionByName(total)
            .withColumn("expense_sales_pct", ratio)
            .withColumn("badge", expense_badge(F.col("expense_sales_pct")))
        )

    return Lists({"parents": parents, "segments": segments, "accounts": accounts})
