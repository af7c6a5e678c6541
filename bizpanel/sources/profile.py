"""Diagnostics: which tables exist, how many rows they hold, what their columns are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_profile(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def catalog_profile(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Existence and row count of catalog tables; NULL count for missing ones."""
    found = [n for n in names if spark.catalog.tableExists(n)]
    missing = [(n, False, None) for n in names if n not in found]
    schema = "table_name string, table_exists boolean, row_count bigint"
    rows = spark.createDataFrame(missing, schema)
    if not found:
        return rows
    present = table_profile({n: spark.table(n) for n in found}).select(
        "table_name", F.lit(True).alias("table_exists"), "row_count"
    )
    return present.unionByName(rows)


def schema_profile(df: DataFrame) -> DataFrame:
    """Declared name, type and nullability per column, with the NULLs found in one scan."""
    fields = df.schema.fields
    nulls = df.agg(
        *[F.count(F.when(F.col(f.name).isNull(), 1)).alias(f.name) for f in fields]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("is_nullable"),
                F.col(f.name).alias("null_rows"),
            )
            for i, f in enumerate(fields, 1)
        ]
    )
    return nulls.select(F.explode(entries).alias("entry")).select("entry.*")
