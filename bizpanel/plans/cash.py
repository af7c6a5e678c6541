"""Cash by period: group summary, account detail, bank balances, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.classify import (
    account_group,
    account_group_name,
    bank_currency,
    cash_state,
)
from bizpanel.functions.numbers import count_if, or_zero, sum_where
from bizpanel.operators.filters import non_empty, prefix
from bizpanel.operators.joins import left_dim
from bizpanel.operators.lists import Lists
from bizpanel.operators.period import Period, prune_years
from bizpanel.plans import ledger
from bizpanel.sources.tables import Tables

LISTS = ("summary", "accounts", "banks")


# Where a ledger line lies, in time order.
BEFORE_YEAR, BEFORE_PERIOD, IN_PERIOD, AFTER_PERIOD = range(4)


def cash_base(
    journal: DataFrame, period: Period, base_currency: str = fixed.BASE_CURRENCY
) -> DataFrame:
    """Cash amounts per account, bank, currency and time window, from one ledger scan.

    A line lies in exactly one of four windows, so each amount is added once per line.
    The three lists are second-level groupings of these few rows. ``lines`` tells a
    group without lines from one whose lines sum to 0.
    """
    date = F.col("journal_date")
    window = (
        F.when(period.before_year(date), BEFORE_YEAR)
        .when(period.before_start(date), BEFORE_PERIOD)
        .when(period.until_end(date), IN_PERIOD)
        .otherwise(AFTER_PERIOD)
    )
    return (
        journal.filter(prefix(F.col("account"), fixed.TREASURY_PREFIX, fixed.BANK_PREFIX))
        .groupBy("account", "bank", "line_currency", window.alias("window"))
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(ledger.native_debit(base_currency)).alias("debit"),
            F.sum(ledger.native_credit(base_currency)).alias("credit"),
            F.sum(ledger.native_balance(base_currency)).alias("native"),
            F.sum(ledger.book_balance()).alias("book"),
        )
    )


def _until(window: int) -> Column:
    return F.col("window") <= window


def _during(window: int) -> Column:
    return F.col("window") == window


def cash_summary(base: DataFrame) -> DataFrame:
    """Year opening and period closing per account group and currency.

    Opening and closing come from one grouping. They are two sides that match on the
    currency, and a NULL currency matches nothing, so it gets a row for each side.
    """
    group = account_group(F.col("account")).alias("account_group")
    amounts = {
        "balance": (IN_PERIOD, "native"),
        "opening_balance": (BEFORE_YEAR, "native"),
        "balance_book": (IN_PERIOD, "book"),
        "opening_balance_book": (BEFORE_YEAR, "book"),
    }
    grouped = (
        base.filter(ledger.is_cash_account() & _until(IN_PERIOD))
        .groupBy(group, "line_currency")
        .agg(
            count_if(_during(BEFORE_YEAR)).alias("opened"),
            *[sum_where(_until(w), F.col(c)).alias(n) for n, (w, c) in amounts.items()],
        )
    )
    # 0 shows both sides in one row, 1 the closing alone, 2 the opening alone.
    apart = F.when(F.col("opened") > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    sides = F.when(F.col("line_currency").isNull(), apart).otherwise(F.array(F.lit(0)))
    hidden_by = {IN_PERIOD: 2, BEFORE_YEAR: 1}
    shown = {
        n: or_zero(F.when(F.col("side") != hidden_by[w], F.col(n))) for n, (w, _) in amounts.items()
    }
    return (
        grouped.withColumn("side", F.explode(sides))
        .select(
            "account_group",
            account_group_name(F.col("account_group")).alias("group_name"),
            "line_currency",
            *[column.alias(n) for n, column in shown.items()],
        )
        .orderBy(F.col("account_group").asc_nulls_first(), F.col("line_currency").asc_nulls_first())
    )


def _movements(base: DataFrame, *keys: str) -> DataFrame:
    """Opening, debit, credit and movement per key, with the lines before and in the period."""
    return base.groupBy(*keys).agg(
        sum_where(_until(BEFORE_PERIOD), F.col("lines")).alias("opening_lines"),
        sum_where(_during(IN_PERIOD), F.col("lines")).alias("period_lines"),
        sum_where(_until(BEFORE_PERIOD), F.col("native")).alias("opening_balance"),
        sum_where(_during(IN_PERIOD), F.col("debit")).alias("total_debit"),
        sum_where(_during(IN_PERIOD), F.col("credit")).alias("total_credit"),
        sum_where(_during(IN_PERIOD), F.col("native")).alias("movement"),
    )


def cash_accounts(
    base: DataFrame, accounts: DataFrame, strict_parity: bool = False
) -> DataFrame:
    """Opening, movement and closing per account and currency.

    Only accounts that move in the period are listed. ``strict_parity`` joins the
    opening on the account alone, which repeats a line of a known currency once per
    opening currency. A line without currency gets no opening either way.
    """
    grouped = _movements(base.filter(ledger.is_cash_account()), "account", "line_currency")
    moving = grouped.filter(F.col("period_lines") > 0)
    known = F.col("line_currency").isNotNull()
    if strict_parity:
        opening = grouped.filter(F.col("opening_lines") > 0).select(
            F.col("account").alias("opening_account"), "opening_balance"
        )
        moving = moving.drop("opening_balance").withColumn(
            "opening_account", F.when(known, F.col("account"))
        )
        moving = left_dim(moving, opening, "opening_account").drop("opening_account")
    else:
        moving = moving.withColumn("opening_balance", F.when(known, F.col("opening_balance")))
    group = account_group(F.col("account"))
    opened = or_zero(F.col("opening_balance"))
    return (
        ledger.with_account_name(moving, accounts)
        .select(
            "account",
            "account_description",
            group.alias("account_group"),
            account_group_name(group).alias("group_name"),
            "line_currency",
            opened.alias("opening_balance"),
            "total_debit",
            "total_credit",
            "movement",
            (opened + F.col("movement")).alias("closing_balance"),
            cash_state(F.col("total_debit"), F.col("total_credit")).alias("cash_state"),
        )
        .orderBy("account_group", F.col("line_currency").asc_nulls_first(), "account")
    )


def bank_balances(base: DataFrame, banks: DataFrame) -> DataFrame:
    """Opening, movement and closing of every bank ever posted to, per currency.

    All bank accounts count here, also those the summary leaves out. Rows without a
    currency are listed with zero amounts.
    """
    posted = prefix(F.col("account"), fixed.BANK_PREFIX) & non_empty(F.col("bank"))
    known = F.col("line_currency").isNotNull()
    amounts = ("opening_balance", "total_debit", "total_credit", "movement")
    grouped = _movements(base.filter(posted), "bank", "line_currency").withColumns(
        {a: or_zero(F.when(known, F.col(a))) for a in amounts}
    )
    names = banks.select(
        F.col("bank_account_number").alias("bank"), "bank_account_name"
    ).distinct()
    return (
        left_dim(grouped, names, "bank")
        .select(
            "bank",
            "bank_account_name",
            "line_currency",
            *amounts,
            (F.col("opening_balance") + F.col("movement")).alias("closing_balance"),
            cash_state(F.col("total_debit"), F.col("total_credit")).alias("cash_state"),
        )
        .orderBy(
            F.col("line_currency").asc_nulls_first(),
            F.abs("closing_balance").desc(),
            "bank",
        )
    )


def bank_list(journal: DataFrame, banks: DataFrame) -> DataFrame:
    """Distinct bank, name and currency of all bank lines."""
    posted = (
        journal.filter(prefix(F.col("account"), fixed.BANK_PREFIX) & non_empty(F.col("bank")))
        .select("bank", "line_currency")
        .distinct()
    )
    names = banks.select(F.col("bank_account_number").alias("bank"), "bank_account_name")
    return left_dim(posted, names, "bank").distinct()


def cash_period(
    tables: Tables,
    period: Period,
    base_currency: str = fixed.BASE_CURRENCY,
    strict_parity: bool = False,
) -> Lists:
    """The cash report: ``summary``, ``accounts`` and ``banks``."""
    tables.require_open(period.year)
    base = cash_base(tables.journal_line, period, base_currency)
    # only the bank list names banks that were first posted to after the period
    ended = prune_years(tables.journal_line, ledger.YEAR_COLUMN, last=period.year).filter(
        period.until_end(F.col("journal_date"))
    )
    until_end = cash_base(ended, period, base_currency)
    return Lists(
        {
            "summary": lambda: cash_summary(until_end),
            "accounts": lambda: cash_accounts(until_end, tables.accounts_master, strict_parity),
            "banks": lambda: bank_balances(base, tables.bank_accounts_master),
        }
    )


def cash_cards(summary: DataFrame, base_currency: str) -> DataFrame:
    """Absolute opening, current and difference per group, in the base currency."""
    in_base = (F.col("line_currency") == base_currency) | ~non_empty(F.col("line_currency"))
    return (
        summary.filter(
            F.col("account_group").isin(*fixed.ACCOUNT_GROUP_NAMES) & in_base
        )
        .groupBy("account_group", "group_name")
        .agg(
            F.sum(F.abs("opening_balance")).alias("opening"),
            F.sum(F.abs("balance")).alias("current"),
        )
        .withColumn("difference", F.col("current") - F.col("opening"))
        .orderBy(F.col("current").desc(), "account_group")
    )


def cash_totals(summary: DataFrame) -> DataFrame:
    """Treasury, bank and grand total of the group balances."""
    group = F.col("account_group")
    return summary.agg(
        or_zero(sum_where(group == fixed.TREASURY_PREFIX, F.col("balance"))).alias(
            "total_treasury"
        ),
        or_zero(sum_where(group == fixed.BANK_PREFIX, F.col("balance"))).alias("total_bank"),
    ).withColumn("grand_total", F.col("total_treasury") + F.col("total_bank"))


def _own_currency_banks(banks: DataFrame) -> DataFrame:
    """Banks whose row currency agrees with the one read from code and name."""
    inferred = bank_currency(F.col("bank"), F.col("bank_account_name"), F.col("line_currency"))
    return banks.withColumn("currency", inferred).filter(
        F.col("line_currency") == F.col("currency")
    )


def bank_totals(banks: DataFrame) -> DataFrame:
    """Number of banks and absolute closing balance per currency."""
    return (
        _own_currency_banks(banks)
        .groupBy("currency")
        .agg(
            F.count(F.lit(1)).alias("banks"),
            F.sum(F.abs("closing_balance")).alias("total"),
        )
    )


def active_banks(banks: DataFrame, currency: str) -> DataFrame:
    """Banks of one currency by falling absolute closing balance."""
    return (
        _own_currency_banks(banks)
        .filter(F.col("currency") == currency)
        .orderBy(F.abs("closing_balance").desc(), "bank")
    )
