"""Control page: key figures of sales, purchasing, expenses and cash."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.classify import expense_badge, payment_badge, target_badge
from bizpanel.functions.numbers import or_zero, pct_of, ratio_pct, sum_where
from bizpanel.operators.joins import one_row
from bizpanel.operators.lists import Lists
from bizpanel.operators.period import Period, prune_years
from bizpanel.plans import ledger
from bizpanel.plans.expenses import expense_accounts, expense_base
from bizpanel.plans.purchasing import in_period, net_amount
from bizpanel.plans.sales import taxable_amount
from bizpanel.sources.tables import Tables

KPI_COLUMNS = (
    "total_sales_amount",
    "total_collection",
    "customer_balance",
    "total_purchasing_amount",
    "total_paid",
    "vendor_balance",
)


def ledger_kpis(journal: DataFrame, period: Period, balance_rows: Column) -> DataFrame:
    """Collection, payments and both balances in one scan of four accounts."""
    in_dates = period.date_filter(F.col("journal_date"))
    customer, vendor = ledger.customer_rows(), ledger.vendor_rows()
    rows = journal.filter((customer | vendor) & (balance_rows | in_dates))
    return rows.agg(
        sum_where(in_dates & ledger.collection_rows(), F.col("credit_book")).alias(
            "total_collection"
        ),
        sum_where(customer & balance_rows, ledger.book_balance()).alias("customer_balance"),
        sum_where(in_dates & ledger.payment_rows(), F.col("debit_book")).alias("total_paid"),
        sum_where(vendor & balance_rows, ledger.book_balance()).alias("vendor_balance"),
    )


def control_kpis(tables: Tables, period: Period, balance_rows: Column) -> DataFrame:
    """The six key figures as one row."""
    tables.require_open(period.year)
    sales = tables.sales_header.filter(in_period(period)).agg(
        F.sum(taxable_amount()).alias("total_sales_amount")
    )
    purchasing = tables.purchase_header.filter(in_period(period)).agg(
        F.sum(net_amount()).alias("total_purchasing_amount")
    )
    return one_row(
        sales, purchasing, ledger_kpis(tables.journal_line, period, balance_rows)
    ).select(*KPI_COLUMNS)


def control_month(tables: Tables, year: int, month: int) -> DataFrame:
    """Key figures of one month; balances are all-time."""
    return control_kpis(tables, Period.monthly(year, [month]), F.lit(True))


def control_period(tables: Tables, period: Period) -> Lists:
    """The control report: ``kpis`` (balances at period end), ``expenses`` and ``cash``."""
    tables.require_open(period.year)
    until_end = period.until_end(F.col("journal_date"))
    journal = prune_years(tables.journal_line, "journal_year", last=period.year)
    return Lists(
        {
            "kpis": lambda: control_kpis(
                tables.replace(journal_line=journal), period, until_end
            ),
            "expenses": lambda: expense_accounts(
                expense_base(journal, period), tables.accounts_master
            ),
            "cash": lambda: ledger.group_balances(journal, period).orderBy("account_group"),
        }
    )


def control_ratios(report: Mapping[str, DataFrame], loyalty: DataFrame) -> DataFrame:
    """Ratios of the control page from its report and the loyalty key figures."""
    group = F.col("account_group")
    cash = report["cash"].agg(
        or_zero(sum_where(group == fixed.TREASURY_PREFIX, F.col("current_balance"))).alias(
            "treasury_balance"
        ),
        or_zero(sum_where(group == fixed.BANK_PREFIX, F.col("current_balance"))).alias(
            "bank_balance"
        ),
        or_zero(
            sum_where(group.isin(*fixed.ACCOUNT_GROUP_NAMES), F.col("difference"))
        ).alias("net_movement"),
    )
    expenses = report["expenses"].agg(
        or_zero(F.sum("total_amount")).alias("total_expenses"),
        F.count(F.lit(1)).alias("expense_accounts"),
    )
    row = one_row(report["kpis"], loyalty, cash, expenses)
    c = F.col

    def average(points: str, cards: str) -> Column:
        both = (c(points) != 0) & (c(cards) != 0)
        return F.when(both, F.round(c(points).cast("double") / c(cards).cast("double"), 1))

    unrounded = pct_of(c("total_expenses"), c("total_sales_amount"), 9)
    ratios = row.select(
        ratio_pct(c("total_collection"), c("total_sales_amount")).alias("collection_ratio"),
        ratio_pct(c("total_paid"), c("total_purchasing_amount")).alias("payment_ratio"),
        ratio_pct(c("total_active_cards"), c("total_charging_cards")).alias("activation_ratio"),
        average("total_charging_points", "total_charging_cards").alias("charging_average"),
        average("total_active_points", "total_active_cards").alias("activation_average"),
        c("total_expenses"),
        F.when(
            c("expense_accounts") > 0, pct_of(c("total_expenses"), c("total_sales_amount"))
        ).alias("expense_sales_pct"),
        F.when(
            c("expense_accounts") > 0, expense_badge(unrounded)
        ).alias("expense_badge"),
        c("treasury_balance"),
        c("bank_balance"),
        (c("treasury_balance") + c("bank_balance")).alias("total_cash"),
        c("net_movement"),
    )
    return ratios.withColumns(
        {
            "collection_badge": target_badge(c("collection_ratio")),
            "payment_badge": payment_badge(c("payment_ratio")),
        }
    )
