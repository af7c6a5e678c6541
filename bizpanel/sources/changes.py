"""Which partitions of a stored table changed, seen from their files alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizpanel.sources import versions

SIGNATURES = "source string, year int, signature long"


def signatures(spark: SparkSession, path: str, source: str, partition: str | None = None) -> DataFrame:
    """One value per partition of a table that changes when any of its files does.

    Path, size and time of each file go in; no column is read. A table without ``partition`` has one value, with a
    NULL year, and of a table of snapshots only the current one counts.
    """
    stored = versions.read(spark, path)
    year = F.col(partition) if partition else F.lit(None).cast("int")
    names = ("file_path", "file_size", "file_modification_time")
    files = stored.select(year.alias("year"), *[F.col(f"_metadata.{n}").alias(n) for n in names]).distinct()
    return files.groupBy("year").agg(F.bit_xor(F.xxhash64(*names)).alias("signature")).select(
        F.lit(source).alias("source"), "year", "signature"
    )


def changed(before: DataFrame, now: DataFrame) -> list[tuple[str, int | None]]:
    """Source and year of the partitions that came, went or differ; as many as there are partitions at most."""
    a, b = before.alias("a"), now.alias("b")
    same = (F.col("a.source") == F.col("b.source")) & F.col("a.year").eqNullSafe(F.col("b.year"))
    differs = ~F.col("a.signature").eqNullSafe(F.col("b.signature"))
    found = a.join(b, same, "full").filter(differs).select(
        F.coalesce("a.source", "b.source").alias("source"), F.coalesce("a.year", "b.year").alias("year")
    )
    return sorted(map(tuple, found.collect()), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
