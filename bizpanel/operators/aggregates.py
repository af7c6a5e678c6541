"""Aggregation, share and top-k shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizpanel.functions.numbers import sum_where


def metrics(df: DataFrame, named: Mapping[str, tuple[Column | None, Column]]) -> DataFrame:
    """Many filtered sums in one scan: ``{name: (predicate, value)}``, None for no filter.

    The frame is first cut to rows that any metric needs, so the test reaches the scan.
    """
    predicates = [p for p, _ in named.values()]
    if all(p is not None for p in predicates):
        wanted = predicates[0]
        for p in predicates[1:]:
            wanted = wanted | p
        df = df.filter(wanted)
    return df.agg(
        *[
            (F.sum(value) if predicate is None else sum_where(predicate, value)).alias(name)
            for name, (predicate, value) in named.items()
        ]
    )


def distinct_count(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """COUNT(DISTINCT column) per key in two levels, so that a hot key spreads by value."""
    groups = df.groupBy(*keys, column).agg(F.lit(1).alias("_seen"))
    return groups.groupBy(*keys).agg(F.count(column).alias(name))


def rollup_parent(detail: DataFrame, parent: str, value: str) -> DataFrame:
    """Totals per parent from an already grouped detail."""
    return detail.groupBy(parent).agg(F.sum(value).alias(value))


def quarterly(trend: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Add monthly measures up to quarters.

    Distinct-client counts added up this way count a client once per month.
    """
    quarter = F.ceil(F.col("month") / F.lit(3)).cast("int").alias("quarter")
    return trend.groupBy(quarter).agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
    )


def footer_totals(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row with the column totals of a table."""
    return df.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def share_of_max(df: DataFrame, value: Column, name: str, largest: Column) -> DataFrame:
    """Value in percent of the largest; NULL when the largest is 0.

    The maximum comes from a scalar subquery, not from a window over one partition.
    """
    top = df.agg(F.max(largest).alias("top")).scalar().cast("double")
    share = F.when(top != 0, value.cast("double") / top * 100.0)
    return df.withColumn(name, share)


def share_of_total(df: DataFrame, value: str, name: str, digits: int = 1) -> DataFrame:
    """Value in percent of the column total; 0 when the total is not positive."""
    total = df.agg(F.sum(value).alias("total")).scalar().cast("double")
    part = F.coalesce(F.col(value), F.lit(0)).cast("double")
    share = F.when(total > 0, F.round(part / total * 100.0, digits))
    return df.withColumn(name, F.coalesce(share, F.lit(0.0)))


def share_of_parent(
    df: DataFrame, value: str, parent: Sequence[str], name: str, digits: int = 1
) -> DataFrame:
    """Value in percent of its parent's total; NULL when either is 0.

    Totals are grouped and joined back, NULL parents included, so that a parent with
    very many children is not one window in one task.
    """
    keys = {f"_parent_{p}": p for p in parent}
    totals = df.groupBy(*[F.col(p).alias(k) for k, p in keys.items()]).agg(
        F.sum(value).alias("_total")
    )
    same = reduce(
        lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(k)) for k, p in keys.items())
    )
    part, total = F.col(value).cast("double"), F.col("_total").cast("double")
    share = F.when((part != 0) & (total != 0), F.round(part / total * 100.0, digits))
    return df.join(totals, same, "left").withColumn(name, share).drop("_total", *keys)


def count_share(df: DataFrame, column: str, amount: str | None = None) -> DataFrame:
    """Head count, share of all rows and optional amount per value; blanks as ``Unknown``."""
    name = F.coalesce(
        F.when(F.col(column) != "", F.col(column)), F.lit("Unknown")
    ).alias("name")
    aggs = [F.count(F.lit(1)).alias("count")]
    if amount:
        aggs.append(F.coalesce(F.sum(amount), F.lit(0)).alias("total_amount"))
    return share_of_total(df.groupBy(name).agg(*aggs), "count", "pct")


def on_category_spine(
    spark: SparkSession, grouped: DataFrame, key: str, categories: Sequence[str]
) -> DataFrame:
    """One row per category in the given order (``position``), zeros kept."""
    spine = spark.createDataFrame(
        [(i, c) for i, c in enumerate(categories)], f"position int, {key} string"
    )
    values = [c for c in grouped.columns if c != key]
    return spine.join(grouped, key, "left").select(
        "position", key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values]
    )


def top_k(df: DataFrame, k: int, by: Sequence[Column]) -> DataFrame:
    """First ``k`` rows in the given order; the order ends in a key to settle ties."""
    return df.orderBy(*by).limit(k)


def latest_k(df: DataFrame, k: int, partition: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """First ``k`` rows per key. Spark cuts each map partition to ``k`` rows per key first."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def latest(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """The ``values`` of the greatest ``order`` row per key, as a combining aggregate."""
    best = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*partition).agg(best.alias("_best")).select(*partition, "_best.*")


def sort_by(
    df: DataFrame, field: str, ascending: bool = True, default: object = "", tie: str | None = None
) -> DataFrame:
    """User-chosen sort: NULLs as ``default``, text without case, ties by key."""
    value = F.coalesce(F.col(field), F.lit(default))
    if isinstance(default, str):
        value = F.lower(value)
    keys = [value.asc() if ascending else value.desc()]
    if tie:
        keys.append(F.col(tie).asc())
    return df.orderBy(*keys)


def preview(df: DataFrame, k: int, by: Sequence[Column]) -> DataFrame:
    """The first rows of a list in its display order."""
    return top_k(df, k, by)
