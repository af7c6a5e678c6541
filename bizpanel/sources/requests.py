"""JSON request documents, one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.operators.period import request_months
from bizpanel.sources.schema import REQUEST_SCHEMA


def is_valid_json(document: Column) -> Column:
    """True for a JSON object or array; false for NULL, empty, scalar or broken text."""
    container = F.coalesce(document, F.lit("")).rlike(r"^\s*[\[{]")
    return container & F.try_parse_json(document).isNotNull()


def json_int(document: Column, path: str) -> Column:
    """Integer at a JSON path; NULL when it is absent or not an integer."""
    return F.get_json_object(document, path).try_cast("int")


def requests(df: DataFrame, document: str) -> DataFrame:
    """Typed request columns of a JSON column; all NULL for broken documents."""
    parsed = F.from_json(F.col(document), REQUEST_SCHEMA, {"mode": "PERMISSIVE"})
    return df.withColumn("_request", parsed).select(
        *df.columns,
        F.col("_request.Period").alias("period"),
        F.col("_request.Months").alias("months"),
        F.col("_request.Quarter").alias("quarter"),
        F.col("_request.Year").alias("year"),
        F.col("_request.CustomerType").alias("customer_type"),
    )


def with_month_list(df: DataFrame) -> DataFrame:
    """Add the month array each request stands for."""
    return df.withColumn(
        "month_list", request_months(F.col("period"), F.col("months"), F.col("quarter"))
    )


def month_rows(df: DataFrame) -> DataFrame:
    """One row per request and month."""
    return with_month_list(df).withColumn("month", F.explode("month_list")).drop("month_list")
