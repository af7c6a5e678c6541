"""Loading and writing the business tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizpanel.operators.lineage import releasing
from bizpanel.sources import closing, versions
from bizpanel.sources.schema import SCHEMAS, YEAR_PARTITIONS

Loader = Callable[[], DataFrame]


class ClosedYear(ValueError):
    """A report asks for the lines of a year of which the ledger holds balances only."""


class Tables:
    """The business tables by name, each read when first used."""

    def __init__(
        self,
        spark: SparkSession,
        loaders: Mapping[str, Loader],
        closed_before: int | None = None,
        stored: bool = False,
    ):
        self.spark = spark
        #: Whether tables are read from their own files, so that a narrower read of a long history is a cheaper one.
        self.stored = stored
        #: The year before which the ledger holds balances only; None if it holds all lines.
        self.closed_before = closed_before
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}

    def require_open(self, year: int) -> None:
        """An error if a report of this year needs ledger lines that are closed."""
        if self.closed_before is not None and year < self.closed_before:
            raise ClosedYear(
                f"the ledger is closed before {self.closed_before}; read the lines of {year} "
                "with Tables.from_parquet(..., closed=False)"
            )

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(f"no table {name!r}")
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self._loaders

    @property
    def names(self) -> list[str]:
        return sorted(self._loaders)

    def replace(self, **frames: DataFrame) -> Tables:
        """Same tables with some of them swapped, such as a compacted ledger."""
        loaders = {**self._loaders, **{n: (lambda f=f: f) for n, f in frames.items()}}
        return Tables(self.spark, loaders, self.closed_before, self.stored)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, closed: bool = True) -> Tables:
        """One Parquet folder per table under ``root``, read with the declared schema.

        Of a table that is stored as snapshots the current one is read. Where years of the ledger have been closed
        (``closing.close_years``), their balances stand in for their lines, and reports of these years raise;
        with ``closed=False`` all lines are read.
        """
        loaders = {
            name: (lambda n=name: versions.read(spark, f"{root}/{n}", SCHEMAS[n])) for name in SCHEMAS
        }
        before = closing.closed_before(spark, root) if closed else None
        if before is not None:
            loaders[closing.LEDGER] = lambda: closing.read_ledger(spark, root)
        return cls(spark, loaders, before, stored=True)

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str]) -> Tables:
        """Tables of other databases or catalogs: ``{"journal_line": "acc.JournalLine"}``."""
        return cls(
            spark,
            {n: (lambda full=full: spark.table(full)) for n, full in names.items()},
        )


def write_fact(df: DataFrame, path: str, year: str, made_from: str | None = None) -> None:
    """Write a fact partitioned by year, replacing only the years it holds.

    ``made_from`` is the expression of the partition column where the fact lacks it.
    Rows are rebalanced by year: adaptive execution joins small years and splits large ones
    by size, so that a year that holds most rows is not one task. The files of that shuffle go with the write.
    """
    dated = df.withColumn(year, F.expr(made_from)) if made_from else df
    with releasing(df.sparkSession):
        (
            dated.hint("rebalance", year)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(year)
            .parquet(path)
        )


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Write a business table where ``Tables.from_parquet`` finds it.

    Facts are written by year. Any other table is published as a new snapshot, so that it may be made from itself.
    """
    path = f"{root}/{name}"
    if name in YEAR_PARTITIONS:
        write_fact(df, path, *YEAR_PARTITIONS[name])
    else:
        versions.publish(df, path)


def _partition(spark: SparkSession, root: str, name: str, column: str, year: int | None) -> tuple[JavaObject, JavaObject]:
    """The file system and the folder of one year of a stored fact."""
    value = "__HIVE_DEFAULT_PARTITION__" if year is None else year
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{column}={value}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def partition_files(spark: SparkSession, root: str, name: str, column: str, year: int | None) -> dict[str, int]:
    """Names and bytes of the files of one year of a stored fact; a year that is written anew has other names."""
    files, path = _partition(spark, root, name, column, year)
    found = files.listStatus(path) if files.exists(path) else ()
    return {status.getPath().getName(): status.getLen() for status in found}


def drop_partition(spark: SparkSession, root: str, name: str, column: str, year: int | None) -> None:
    """Remove the partition of one year from a stored fact."""
    files, path = _partition(spark, root, name, column, year)
    files.delete(path, True)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a table bucketed by its invoice id, so that header and line join without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
