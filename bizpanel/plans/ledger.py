"""Shared ledger measures and the yearly compaction that bounds balance scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.classify import account_group, account_group_name
from bizpanel.functions.numbers import native_amount, or_zero
from bizpanel.operators.filters import doc_type, in_list, not_in_list, positive, prefix
from bizpanel.operators.joins import left_dim
from bizpanel.operators.period import Period, prune_years

AMOUNTS = ("debit_book", "credit_book", "debit_txn", "credit_txn")
#: The year partition of the stored ledger.
YEAR_COLUMN = "journal_year"


def book_balance() -> Column:
    return F.col("debit_book") - F.col("credit_book")


def native(book: Column, transaction: Column, base_currency: str) -> Column:
    return native_amount(F.col("line_currency"), base_currency, book, transaction)


def native_debit(base_currency: str) -> Column:
    return native(F.col("debit_book"), F.col("debit_txn"), base_currency)


def native_credit(base_currency: str) -> Column:
    return native(F.col("credit_book"), F.col("credit_txn"), base_currency)


def native_balance(base_currency: str) -> Column:
    return native(book_balance(), F.col("debit_txn") - F.col("credit_txn"), base_currency)


def is_cash_account() -> Column:
    """Treasury and bank accounts without the excluded ones."""
    return prefix(
        F.col("account"), fixed.TREASURY_PREFIX, fixed.BANK_PREFIX
    ) & not_in_list(F.col("account"), fixed.NON_CASH_ACCOUNTS)


def collection_rows() -> Column:
    """Customer receipts: credits of the customer accounts from receipt documents."""
    return (
        in_list(F.col("account"), fixed.CUSTOMER_ACCOUNTS)
        & doc_type(F.col("journal_no"), fixed.COLLECTION_DOCUMENTS)
        & positive(F.col("credit_book"))
    )


def payment_rows() -> Column:
    """Vendor payments: debits of the vendor accounts from payment documents."""
    return (
        in_list(F.col("account"), fixed.VENDOR_ACCOUNTS)
        & doc_type(F.col("journal_no"), fixed.PAYMENT_DOCUMENTS)
        & positive(F.col("debit_book"))
    )


def customer_rows() -> Column:
    return in_list(F.col("account"), fixed.CUSTOMER_ACCOUNTS)


def vendor_rows() -> Column:
    return in_list(F.col("account"), fixed.VENDOR_ACCOUNTS)


def expense_rows(period: Period) -> Column:
    return in_list(F.col("account"), fixed.EXPENSE_ACCOUNTS) & period.date_filter(
        F.col("journal_date")
    )


def with_account_name(df: DataFrame, accounts: DataFrame) -> DataFrame:
    names = accounts.select(F.col("account_number").alias("account"), "account_description")
    return left_dim(df, names, "account")


def by_account_group(journal: DataFrame, value: Column, name: str) -> DataFrame:
    """Sum per three-character account group."""
    return journal.groupBy(account_group(F.col("account")).alias("account_group")).agg(
        F.sum(value).alias(name)
    )


def group_balances(journal: DataFrame, period: Period) -> DataFrame:
    """Year opening, period-end balance and their difference per cash account group."""
    date = F.col("journal_date")
    groups = (
        prune_years(journal, YEAR_COLUMN, last=period.year)
        .filter(is_cash_account() & period.until_end(date))
        .groupBy(account_group(F.col("account")).alias("account_group"))
        .agg(
            or_zero(F.sum(F.when(period.before_year(date), book_balance()))).alias(
                "opening_balance"
            ),
            F.sum(book_balance()).alias("current_balance"),
        )
    )
    return groups.select(
        "account_group",
        account_group_name(F.col("account_group")).alias("group_name"),
        "opening_balance",
        "current_balance",
        (F.col("current_balance") - F.col("opening_balance")).alias("difference"),
    )


def compact_years(journal: DataFrame) -> DataFrame:
    """The ledger summed to one row per year, account, currency, bank and vendor.

    The rows keep the ledger's own shape, dated on the last day of their year, so that
    every balance over whole years comes out the same. Document types are lost, so
    closed years in this form serve balances, not collections or payments.
    """
    year = F.year("journal_date")
    return (
        journal.groupBy(year.alias("year"), "account", "line_currency", "bank", "vendor")
        .agg(*[F.sum(a).alias(a) for a in AMOUNTS])
        .select(
            "account",
            F.make_date("year", F.lit(12), F.lit(31)).alias("journal_date"),
            *AMOUNTS,
            "line_currency",
            "bank",
            "vendor",
        )
    )


def with_compacted_years(journal: DataFrame, compacted: DataFrame, year: int) -> DataFrame:
    """Compacted rows for the years before ``year``, ledger lines from then on.

    Reports must lie in ``year`` or later: a compacted row stands on the last day of its year.
    Where the ledger has its partition column, compacted rows get theirs from their date, and
    the partitions of closed years are not read.
    """
    first_day = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    history = compacted.filter(F.col("journal_date") < first_day)
    if YEAR_COLUMN in journal.columns:
        history = history.withColumn(YEAR_COLUMN, F.year("journal_date"))
    current = prune_years(journal, YEAR_COLUMN, first=year).filter(F.col("journal_date") >= first_day)
    return current.unionByName(history, allowMissingColumns=True)
