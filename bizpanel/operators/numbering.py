"""Gapless numbers over all rows of a frame, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizpanel.operators.lineage import cut

_ROW_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in the given order, whatever the partitions.

    Rows are sorted over range partitions and stored, so that the ranges stay the same when a task is repeated. The
    rows of each partition are counted, and a row's number is its place in the partition behind the rows of those
    before: only one count for each partition is gathered. Rows that are equal in the order, as many as there may be,
    are divided between partitions by a further number and get neighbouring numbers in no set order.
    """
    tie, part, at = (f"{name}_{x}" for x in ("tie", "part", "at"))
    keys = [*order, tie]
    stored = cut(
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
        .drop(tie)
    )
    counts = stored.groupBy(part).count()
    # one row for each partition, however many rows there are
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rows_before"))
    return (
        stored.join(F.broadcast(offsets), part)
        .withColumn(name, F.col("rows_before") + F.col(at) + 1)
        .drop(part, at, "rows_before")
    )
