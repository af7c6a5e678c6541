"""Cuts lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode one is made where none is set.

    On a cluster without that setting this is an error: a machine-local folder would lose rows.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(frame: DataFrame, *by: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back; with ``by``, in a folder for each value.

    The table no longer needs the shuffles that made it, so that Spark may remove their files.
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = frame.write.partitionBy(*by) if by else frame.write
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        writer.parquet(folder)
    finally:
        spark.conf.set(_RELEASE, before)
    return spark.read.schema(frame.schema).parquet(folder)


def drop(table: DataFrame, part: str = "") -> None:
    """Removes the files of a stored table, or those of one of its parts, that nothing reads any more."""
    files = table.inputFiles()
    if files:
        folder = files[0][: files[0].index("/table-") + len("/table-") + 32]
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}" if part else folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes up to which a measured side is broadcast.
BROADCAST_BYTES = 8 << 20


def small(frame: DataFrame, row_bytes: int, measured: int | None = None) -> DataFrame:
    """The frame with a broadcast hint if its measured rows stay below BROADCAST_BYTES.

    Beyond that it comes back as it is, and Spark joins by shuffle.
    """
    rows = frame.count() if measured is None else measured
    return F.broadcast(frame) if rows * row_bytes <= BROADCAST_BYTES else frame
