"""Cutting the lineage of iterative jobs on reliable storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; in local mode without that setting, one in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(
        CHECKPOINT_SETTING, None
    )
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints-{uuid.uuid4().hex}"
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Each query made and run meanwhile gives up its shuffle files when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)
