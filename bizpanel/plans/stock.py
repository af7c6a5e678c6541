"""Raw and packing stock: valuation at the last invoice price, list view, key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.numbers import count_if, or_default, or_zero, sum_if
from bizpanel.operators.aggregates import latest, sort_by
from bizpanel.operators.filters import having, item_bucket, non_empty, not_in_list, search
from bizpanel.operators.joins import header_lines, left_dim
from bizpanel.sources.tables import Tables

STOCK_SEARCH_COLUMNS = ("item_code", "item_extra_description")
SAFETY_SEARCH_COLUMNS = (
    "item_code",
    "item_description",
    "purchasing_warehouse",
    "production_warehouse",
)
NUMERIC_FIELDS = ("item_balance", "last_price", "item_amount", "item_amount_base", "safety_stock")
DATE_FIELDS = ("last_invoice_date", "created_date", "last_maint_date")


def last_price(header: DataFrame, line: DataFrame) -> DataFrame:
    """Price, currency, date and rate of each item's latest invoice.

    Latest by invoice date, then invoice id; of several lines of one item on that
    invoice the highest price counts. Lines are reduced to one per invoice and item before the
    join, and the latest invoice is taken by a combining aggregate, so that neither a long
    invoice nor a much-bought item ends up whole in one task.
    """
    # spread by both keys: the lines of an invoice that holds most of them meet in many tasks
    prices = (
        line.filter(non_empty(F.col("item_code")))
        .groupBy("int_id", "item_code")
        .agg(F.max("price").alias("last_price"))
    )
    return merge_prices(
        header_lines(_dated(header), prices).select(*PRICE_KEYS, *PRICE_FIELDS)
    ).select("item_code", *PRICE_FIELDS)


#: What a price's place in time is, and what a report takes from it.
PRICE_KEYS = ("item_code", "internal_id")
PRICE_FIELDS = ("last_price", "last_currency", "last_invoice_date", "last_exchange_rate")


def merge_prices(prices: DataFrame) -> DataFrame:
    """The latest of all prices of each item, with the invoice that it stands on.

    The result has the shape of what goes in, so that results over parts of the invoices can be merged
    again: by date, then invoice, then price, in any order and grouping.
    """
    return latest(
        prices,
        ["item_code"],
        ["last_invoice_date", "internal_id", "last_price"],
        ["internal_id", *PRICE_FIELDS],
    )


def _dated(header: DataFrame) -> DataFrame:
    return header.select(
        "internal_id",
        F.col("invoice_currency").alias("last_currency"),
        F.col("invoice_date").alias("last_invoice_date"),
        F.col("invoice_exchange_rate").alias("last_exchange_rate"),
    )


def item_stock(balance: DataFrame, items: DataFrame) -> DataFrame:
    """Non-zero stock per item code, without the excluded types."""
    per_item = balance.groupBy("item_code", "item_id").agg(
        F.sum("item_balance").alias("item_balance")
    )
    grouped = (
        left_dim(
            per_item, items.select("item_id", "item_type", "item_extra_description"), "item_id"
        )
        .groupBy("item_code", "item_type", "item_extra_description")
        .agg(F.sum("item_balance").alias("item_balance"))
    )
    kept = having(
        grouped,
        (F.col("item_balance") != 0)
        & not_in_list(or_default(F.col("item_type"), ""), fixed.EXCLUDED_STOCK_TYPES),
    )
    return kept.select(
        "item_code",
        or_default(F.col("item_type"), "N/A").alias("item_type"),
        or_default(F.col("item_extra_description"), "").alias("item_extra_description"),
        "item_balance",
    )


def with_last_price(stock: DataFrame, prices: DataFrame) -> DataFrame:
    """Value the stock; items never bought get price 0 and rate 1."""
    price = or_zero(F.col("last_price"))
    rate = or_default(F.col("last_exchange_rate"), 1)
    balance = F.col("item_balance")
    return left_dim(stock, prices, "item_code").select(
        "item_code",
        "item_type",
        "item_extra_description",
        "item_balance",
        price.alias("last_price"),
        or_default(F.col("last_currency"), "").alias("last_currency"),
        (price * balance).alias("item_amount"),
        "last_invoice_date",
        rate.alias("last_exchange_rate"),
        (price * rate * balance).alias("item_amount_base"),
    )


def stock_valuation(tables: Tables) -> DataFrame:
    """Stock of raw, packing and other items at the last invoice price and rate."""
    return with_last_price(
        item_stock(tables.item_balance, tables.item_master),
        last_price(tables.purchase_header, tables.purchase_line),
    ).orderBy("item_code")


def stock_kpis(stock: DataFrame) -> DataFrame:
    """Counts, positive and negative stock, and value per type, in one pass."""
    raw, pack = item_bucket(F.col("item_type"), "R"), item_bucket(F.col("item_type"), "P")
    others = item_bucket(F.col("item_type"), "OTHERS")
    balance, value = or_zero(F.col("item_balance")), or_zero(F.col("item_amount_base"))
    sums = {
        "positive_stock": sum_if(balance > 0, balance),
        "negative_stock": sum_if(balance < 0, balance),
        "raw_value": sum_if(raw, value),
        "pack_value": sum_if(pack, value),
        "others_value": sum_if(others, value),
    }
    return stock.agg(
        F.count(F.lit(1)).alias("items"),
        count_if(raw).alias("raw_count"),
        count_if(pack).alias("pack_count"),
        count_if(others).alias("others_count"),
        count_if(or_zero(F.col("last_price")) == 0).alias("items_without_price"),
        *[or_zero(value).alias(name) for name, value in sums.items()],
    )


def _sorted(df: DataFrame, field: str, ascending: bool, tie: str) -> DataFrame:
    """Sort by a chosen field: missing numbers as 0, missing dates first, text without case."""
    if field in NUMERIC_FIELDS:
        return sort_by(df, field, ascending, 0, tie)
    if field in DATE_FIELDS:
        key = F.col(field).asc_nulls_first() if ascending else F.col(field).desc_nulls_last()
        return df.orderBy(key, F.col(tie).asc())
    return sort_by(df, field, ascending, "", tie)


def stock_view(
    stock: DataFrame,
    query: str = "",
    bucket: str = "ALL",
    field: str = "item_code",
    ascending: bool = True,
) -> dict[str, DataFrame]:
    """Searched, typed and sorted stock ``list``, with the ``kpis`` of what is shown."""
    shown = search(stock, query, STOCK_SEARCH_COLUMNS).filter(
        item_bucket(F.col("item_type"), bucket)
    )
    return {"list": _sorted(shown, field, ascending, "item_code"), "kpis": stock_kpis(shown)}


def safety_kpis(items: DataFrame) -> DataFrame:
    """Records, quantity, counts per type, and distinct warehouses over both columns."""
    kind = F.upper(or_default(F.col("item_type"), ""))
    named = F.filter(
        F.array("purchasing_warehouse", "production_warehouse"),
        lambda w: w.isNotNull() & (w != ""),
    )
    warehouses = items.select(F.explode(named).alias("w")).agg(F.countDistinct("w"))
    return items.agg(
        F.count(F.lit(1)).alias("records"),
        or_zero(F.sum("safety_stock")).alias("total_quantity"),
        count_if(item_bucket(kind, "R")).alias("raw_count"),
        count_if(item_bucket(kind, "P")).alias("pack_count"),
        count_if(item_bucket(kind, "OTHERS")).alias("others_count"),
    ).withColumn("warehouses", warehouses.scalar())


def list_safety_stock(tables: Tables) -> DataFrame:
    """All safety-stock records."""
    return tables.safety_stock


def safety_stock_view(
    items: DataFrame,
    query: str = "",
    bucket: str = "ALL",
    field: str = "item_code",
    ascending: bool = True,
) -> dict[str, DataFrame]:
    """Searched, typed and sorted safety-stock ``list``, with the ``kpis`` of what is shown."""
    shown = search(items, query, SAFETY_SEARCH_COLUMNS).filter(
        item_bucket(F.upper(F.col("item_type")), bucket)
    )
    return {"list": _sorted(shown, field, ascending, "id"), "kpis": safety_kpis(shown)}
