"""Exact distinct counts that can be merged: one bit for each value seen.

A count of distinct values over several months is not the sum of the months' counts. Bitmaps of the months can be
joined bit by bit, and the bits of the result are the count. Each row holds the bits of 32,768 neighbouring values, so
that a group of many values lies in many rows and no task holds it whole. A row takes 4 KB in memory, however few bits it
has; Parquet stores what is empty in a few bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITMAP = "bucket", "bitmap"


def bitmaps(df: DataFrame, keys: Sequence[str | Column], column: str) -> DataFrame:
    """The keys, a bucket of values, and its bitmap. The column is integral; its NULLs are not counted."""
    value = F.col(column)
    return (
        df.filter(value.isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(value).alias(BUCKET))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias(BITMAP))
    )


def merge_bitmaps(stored: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """The bitmaps of coarser keys, in the same shape, from those of finer keys."""
    return stored.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def distinct_where(predicate: Column) -> Column:
    """Number of values in the merged bitmaps of which the predicate holds."""
    return F.coalesce(F.sum(F.when(predicate, F.bitmap_count(BITMAP))), F.lit(0))


def distinct_of(stored: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact number of distinct values for each of the keys, which may be coarser than the stored ones."""
    merged = merge_bitmaps(stored, keys)
    return merged.groupBy(*keys).agg(distinct_where(F.lit(True)).alias(name))
