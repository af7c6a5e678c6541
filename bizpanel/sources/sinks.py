"""Report exports: column titles, display dates, CSV or Parquet output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.functions.numbers import or_zero
from bizpanel.functions.text import date_text, number_text

FORMATS = ("csv", "parquet")


def _text(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def _with_currency(amount: str, currency: str):
    """Amount and currency in one text cell."""
    return F.concat(number_text(or_zero(F.col(amount))), F.lit(" "), _text(currency))


def stock_export(stock: DataFrame) -> DataFrame:
    """Stock valuation as a sheet: amounts with their currency, ISO dates."""
    return stock.select(
        _text("item_code").alias("Item Code"),
        _text("item_type").alias("Type"),
        _text("item_extra_description").alias("Item Extra Description"),
        or_zero(F.col("item_balance")).alias("Balance"),
        _with_currency("last_price", "last_currency").alias("Last Price"),
        date_text(F.col("last_invoice_date"), "iso").alias("Last Invoice Date"),
        _with_currency("item_amount", "last_currency").alias("Amount"),
        or_zero(F.col("item_amount_base")).alias("Amount (Base)"),
    )


def safety_stock_export(items: DataFrame) -> DataFrame:
    """Safety stock as a sheet, timestamps to the minute."""
    return items.select(
        _text("item_code").alias("Item Code"),
        _text("item_type").alias("Item Type"),
        _text("item_description").alias("Item Description"),
        or_zero(F.col("safety_stock")).alias("Safety Stock"),
        _text("purchasing_warehouse").alias("Purchasing Warehouse"),
        _text("production_warehouse").alias("Production Warehouse"),
        _text("created_by").alias("Created By"),
        date_text(F.col("created_date"), "minute").alias("Created Date"),
        _text("last_maint_by").alias("Last Maint By"),
        date_text(F.col("last_maint_date"), "minute").alias("Last Maint Date"),
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report with a header row; every executor writes its own part file."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
