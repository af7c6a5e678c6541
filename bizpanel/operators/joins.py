"""Join shapes.

No broadcast hints are given on tables: Spark compares their size with
``spark.sql.autoBroadcastJoinThreshold`` at planning time and again at run time,
and falls back to a sort-merge join whose hot partitions AQE splits. Reports
aggregate facts on the join key first, so a key that holds a third of all rows
reaches the join as one row. Only frames whose row count is bounded by
construction (12 months, 25 leaders) are broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def left_dim(
    fact: DataFrame, dim: DataFrame, on: Sequence[str] | str, salts: int = 1
) -> DataFrame:
    """Left outer join of a fact with a dimension on equally named keys.

    ``salts`` splits every key of the fact over that many groups and repeats the
    dimension as often, for facts that cannot be summed first and a dimension too
    large to broadcast.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if salts <= 1:
        return fact.join(dim, keys, "left")
    spread = F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = fact.withColumn("_salt", spread)
    return salted.join(dim.withColumn("_salt", copies), [*keys, "_salt"], "left").drop("_salt")


def header_lines(header: DataFrame, line: DataFrame) -> DataFrame:
    """Inner join of invoice headers (``internal_id``) with their lines (``int_id``)."""
    return header.join(line, header["internal_id"] == line["int_id"], "inner")


def bounded_by(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key lies between the least and largest key of the other frame; none beyond finds a partner there.

    The bounds are scalar subqueries, known before the scan starts: Parquet row groups outside them are not read, and
    what is left is what is shuffled. It pays where keys run with time, as invoice ids do, and the other frame holds a few years
    of a long history; it is right for any keys. Without rows on the other side nothing is left.
    """
    keys = other.select(other_key)
    least = keys.agg(F.min(other_key)).scalar()
    # not an aggregate too: Spark would merge both into one subquery of two fields, which does not reach the Parquet scan
    most = keys.orderBy(F.col(other_key).desc_nulls_last()).limit(1).scalar()
    return df.filter((F.col(key) >= least) & (F.col(key) <= most))


def full_merge(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two aggregates with coalesced keys.

    NULL keys never match each other: each side keeps its own row.
    """
    left, right = a.alias("l"), b.alias("r")
    condition = reduce(
        lambda x, y: x & y, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys)
    )
    merged_keys = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    rest = [F.col(f"l.{c}") for c in a.columns if c not in keys]
    rest += [F.col(f"r.{c}") for c in b.columns if c not in keys]
    return left.join(right, condition, "full").select(*merged_keys, *rest)


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows whose key occurs in ``keys``; duplicates there do not matter."""
    return df.join(keys, on, "left_semi")


def exists_flag(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Add a boolean column: the key occurs in ``keys``."""
    marked = keys.select(on).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def lookup(
    df: DataFrame,
    key: str,
    master: DataFrame,
    master_key: str,
    value: str,
    name: str,
    salts: int = 1,
) -> DataFrame:
    """Attach ``value`` of the master row whose unique key equals ``key``."""
    values = master.select(F.col(master_key).alias(key), F.col(value).alias(name))
    return left_dim(df, values, key, salts)


def with_scalar_sum(
    df: DataFrame, fact: DataFrame, on: Sequence[str], amount: Column, name: str
) -> DataFrame:
    """Attach the sum of a fact per key; keys without facts get 0.

    The fact is summed first, so the join is one row to one.
    """
    totals = fact.groupBy(*on).agg(F.sum(amount).alias(name))
    return df.join(totals, list(on), "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(0))
    )


def attach_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach the single value of a one-row, one-column frame to every row."""
    return df.withColumn(name, one_row.scalar())


def one_row(*frames: DataFrame) -> DataFrame:
    """Put the columns of one-row frames side by side.

    The rows are stacked and folded, which needs no cross join. Column names must differ.
    """
    columns = [c for frame in frames for c in frame.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.expr(f"max(`{c}`) AS `{c}`") for c in columns])


def with_parent(df: DataFrame, segments: DataFrame, segment_id: int) -> DataFrame:
    """Attach the description and the parent of a segment from the self-referencing master."""
    chosen = segments.filter(F.col("segment_id") == segment_id)
    child = chosen.select(
        F.col("segment_value").alias("segment9"),
        F.col("value_description").alias("segment_description"),
        "parent_value",
    )
    parent = chosen.select(
        F.col("segment_value").alias("parent_value"),
        F.col("value_description").alias("parent_description"),
    )
    return df.join(child, "segment9", "left").join(parent, "parent_value", "left")


def months_df(spark: SparkSession) -> DataFrame:
    """The twelve month numbers."""
    return spark.range(1, 13, numPartitions=1).select(F.col("id").cast("int").alias("month"))


def on_month_spine(spark: SparkSession, by_month: DataFrame) -> DataFrame:
    """Twelve rows, months without data as zeros. ``by_month`` has one row per month."""
    bounded = by_month.filter(F.col("month").between(1, 12))
    values = [c for c in by_month.columns if c != "month"]
    return (
        months_df(spark)
        .join(F.broadcast(bounded), "month", "left")
        .select("month", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values])
    )
