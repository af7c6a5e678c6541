"""Purchasing: one month, by period, top vendors, vendor balances, mix."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.classify import payment_badge
from bizpanel.functions.numbers import or_zero, ratio_pct
from bizpanel.operators.aggregates import metrics, share_of_max, top_k
from bizpanel.operators.filters import in_list, prefix
from bizpanel.operators.joins import bounded_by, left_dim, one_row
from bizpanel.operators.lists import Lists
from bizpanel.operators.period import Period
from bizpanel.plans import ledger
from bizpanel.sources.tables import Tables


def net_amount() -> Column:
    return (F.col("total_lines_amount") - F.col("total_discount")) * F.col(
        "invoice_exchange_rate"
    )


def in_period(period: Period) -> Column:
    """Invoices of the stored year whose date falls in the month set."""
    return (F.col("invoice_year") == period.year) & period.month_filter(F.col("invoice_date"))


def header_totals(header: DataFrame, period: Period) -> DataFrame:
    """Total and local purchasing in one scan."""
    chosen = in_period(period)
    local = prefix(F.col("vendor_type"), fixed.LOCAL_VENDOR_PREFIX)
    return metrics(
        header,
        {
            "total_purchasing_amount": (chosen, net_amount()),
            "local_purchasing": (chosen & local, net_amount()),
        },
    )


def vendor_ledger(journal: DataFrame, period_rows: Column, balance_rows: Column) -> DataFrame:
    """Payments of the period and the vendor balance, in one ledger scan."""
    return metrics(
        journal.filter(ledger.vendor_rows()),
        {
            "total_paid": (period_rows & ledger.payment_rows(), F.col("debit_book")),
            "vendor_balance": (balance_rows, ledger.book_balance()),
        },
    )


def raw_purchasing(
    header: DataFrame, line: DataFrame, period: Period, bounded: bool = False
) -> DataFrame:
    """Raw and packing lines of the line year, at the header's rate and month.

    Their headers may be dated in any year; ``bounded`` reads those only that the lines' ids leave possible.

    The rate is one per invoice, so lines are summed per invoice before the join.
    """
    bought = line.filter(
        (F.col("inv_year") == period.year)
        & in_list(F.col("item_type"), fixed.RAW_AND_PACKING_TYPES)
    )
    per_invoice = bought.groupBy(F.col("int_id").alias("internal_id")).agg(
        F.sum(F.col("line_amount") - F.col("line_discount")).alias("amount")
    )
    dated = header.filter(period.month_filter(F.col("invoice_date")))
    if bounded:
        dated = bounded_by(dated, "internal_id", bought, "int_id")
    dated = dated.select("internal_id", "invoice_exchange_rate")
    return per_invoice.join(dated, "internal_id").agg(
        F.sum(F.col("amount") * F.col("invoice_exchange_rate")).alias("raw_purchasing")
    )


def top_vendors(tables: Tables, period: Period, k: int = fixed.VENDOR_LIST_SIZE) -> DataFrame:
    """Vendors by falling purchase amount, summed per vendor before the name join."""
    totals = (
        tables.purchase_header.filter(in_period(period))
        .groupBy("vendor_number")
        .agg(F.sum(net_amount()).alias("total_amount"))
    )
    named = (
        left_dim(totals, tables.vendor_master, "vendor_number")
        .groupBy("vendor_number", F.col("vendor_extra_name").alias("vendor_name"))
        .agg(F.sum("total_amount").alias("total_amount"))
    )
    order = [
        F.col("total_amount").desc_nulls_last(),
        F.col("vendor_number").asc_nulls_first(),
        F.col("vendor_name").asc_nulls_first(),
    ]
    return top_k(named, k, order)


def lowest_balances(tables: Tables, k: int = fixed.VENDOR_LIST_SIZE) -> DataFrame:
    """Vendor *names* by rising balance; vendors without a name are one group."""
    totals = (
        tables.journal_line.filter(ledger.vendor_rows())
        .groupBy(F.col("vendor").alias("vendor_number"))
        .agg(F.sum(ledger.book_balance()).alias("vendor_balance"))
    )
    named = (
        left_dim(totals, tables.vendor_master, "vendor_number")
        .groupBy(F.col("vendor_extra_name").alias("vendor_name"))
        .agg(F.sum("vendor_balance").alias("vendor_balance"))
    )
    order = [
        F.col("vendor_balance").asc_nulls_first(),
        F.col("vendor_name").asc_nulls_first(),
    ]
    return top_k(named, k, order)


def purchasing_kpis(tables: Tables, period: Period) -> DataFrame:
    """Totals, payments and balance as one row.

    Import and other purchasing are differences and stay NULL when a part is NULL.
    """
    tables.require_open(period.year)
    in_dates = period.date_filter(F.col("journal_date"))
    return one_row(
        header_totals(tables.purchase_header, period),
        raw_purchasing(tables.purchase_header, tables.purchase_line, period, tables.stored),
        vendor_ledger(tables.journal_line, in_dates, F.lit(True)),
    ).withColumns(
        {
            "import_purchasing": F.col("total_purchasing_amount") - F.col("local_purchasing"),
            "other_purchasing": F.col("total_purchasing_amount") - F.col("raw_purchasing"),
        }
    )


def purchasing_period(tables: Tables, period: Period) -> Lists:
    """The purchasing report: ``kpis``, ``vendors`` and ``balances``."""
    return Lists(
        {
            "kpis": lambda: purchasing_kpis(tables, period),
            "vendors": lambda: top_vendors(tables, period),
            "balances": lambda: lowest_balances(tables),
        }
    )


def purchasing_month(tables: Tables, year: int, month: int) -> Lists:
    """The purchasing report of one month."""
    return purchasing_period(tables, Period.monthly(year, [month]))


def mix_shares(kpis: DataFrame) -> DataFrame:
    """Local, import, raw and other purchasing with their shares of the total."""
    total = or_zero(F.col("total_purchasing_amount"))
    parts = ("local", "import", "raw", "other")
    return kpis.select(
        total.alias("total_purchasing"),
        *[or_zero(F.col(f"{p}_purchasing")).alias(f"{p}_purchasing") for p in parts],
        *[ratio_pct(F.col(f"{p}_purchasing"), total).alias(f"{p}_pct") for p in parts],
        ratio_pct(F.col("total_paid"), total).alias("payment_ratio"),
    ).withColumn("payment_badge", payment_badge(F.col("payment_ratio")))


def purchasing_mix(report: Mapping[str, DataFrame]) -> Lists:
    """Shares of the purchasing report: ``mix`` of the total, ``vendors``, ``balances``.

    Balance bars divide absolute values by the largest *signed* balance, as displayed.
    """

    def shares(rows: DataFrame, value: Column, signed: Column, whole: str) -> DataFrame:
        total = report["kpis"].select(whole).scalar()
        bars = share_of_max(rows, value, "bar_pct", or_zero(signed))
        return bars.withColumn("share_pct", ratio_pct(value, total))

    amount, balance = F.col("total_amount"), F.col("vendor_balance")
    return Lists(
        {
            "mix": lambda: mix_shares(report["kpis"]),
            "vendors": lambda: shares(
                report["vendors"], amount, amount, "total_purchasing_amount"
            ),
            "balances": lambda: shares(
                report["balances"], F.abs(balance), balance, "vendor_balance"
            ),
        }
    )
