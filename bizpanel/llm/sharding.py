"""Sharding by histogram sort: exact counts refine the splitters, then rows move once.

Each row has one sortable key: the upper half of a hash of its text, so that equal texts stand
together, and below it the lower half of a hash of its id and its place in the input, so that a hot text, and rows that
are repeated whole, can still be divided.
Splitters are sought for equal bytes. In each round every task counts the bytes of its rows between
the probes of all open splitters; the sums say between which two probes a splitter lies, and new
probes go there, until the bytes below it are within tolerance or no key lies between its bounds.
Each shard is made of several key ranges found in the same way, so that numbering the rows of a
shard is not one task.

Law: ``bytes``. Every shard's bytes differ from an equal share by at most twice the tolerance, plus
the bytes of rows with equal keys that a splitter falls on.

Defined results: a null text counts as empty; a null id is hashed like any other value. Rows that
are repeated whole are divided like others. Extra columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizpanel.llm.scratch import store

LAW = "bytes"
#: Share of a shard's bytes by which the bytes below a splitter may be off.
TOLERANCE = 0.002
#: Probes of one round, over all open splitters; each has two at least.
PROBES = 2048
#: Bytes of a key range, from which the number of ranges of a shard follows; four at least.
RANGE_BYTES = 1 << 30
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def sort_key(id_column: str, text: Column) -> Column:
    """Equal texts side by side, in the order of a hash of their ids and of their places; to be stored at once."""
    upper = F.shiftleft(F.shiftright(F.xxhash64(text), 32), 32)
    own = F.xxhash64(F.col(id_column), F.monotonically_increasing_id())
    return upper.bitwiseOR(own.bitwiseAND(F.lit(0xFFFFFFFF)))


@dataclass
class _Splitter:
    """Keys below ``low`` hold too few bytes, keys below ``high`` enough."""

    target: float
    low: int = _LOW
    high: int = _HIGH
    key: int | None = None


def bytes_between(keyed: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of the rows below each probe; each task sends one sum for each gap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            gap = np.searchsorted(probes, batch.column("key").to_numpy(), "right")
            np.add.at(total, gap, batch.column("size").to_numpy())
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["gap", "bytes"]
        )

    sums = (
        keyed.select("key", "size")
        .mapInArrow(count, "gap long, bytes long")
        .groupBy("gap")
        .agg(F.sum("bytes").alias("bytes"))
        .toPandas()
    )
    gaps = np.zeros(len(probes) + 1, np.int64)
    gaps[sums["gap"].to_numpy(np.int64)] = sums["bytes"].to_numpy(np.int64)
    return np.cumsum(gaps)[:-1]


def find_splitters(keyed: DataFrame, total: int, parts: int, tolerance: float) -> list[int]:
    """Keys at which 1, 2, ... of ``parts`` equal shares of the bytes lie below."""
    splitters = [_Splitter(total * j / parts) for j in range(1, parts)]
    while open_ones := [s for s in splitters if s.key is None]:
        each = max(2, PROBES // len(open_ones))
        wanted = {
            s.low + (s.high - s.low) * k // (each + 1) for s in open_ones for k in range(1, each + 1)
        } | {s.high for s in open_ones}
        probes = np.array(sorted(wanted), np.int64)
        below = bytes_between(keyed, probes)
        for s in open_ones:
            enough = int(np.searchsorted(below, s.target))
            near = [i for i in (enough - 1, enough) if 0 <= i < len(probes)]
            best = min(near, key=lambda i: abs(below[i] - s.target))
            if abs(below[best] - s.target) <= tolerance:
                s.key = int(probes[best])
                continue
            if enough < len(probes):
                s.high = min(s.high, int(probes[enough]))
            if enough > 0:
                s.low = max(s.low, int(probes[enough - 1]))
            if s.high - s.low <= 1:
                s.key = s.high if enough < len(probes) else int(probes[-1])
    return sorted(s.key for s in splitters)


def shard_rows(
    documents: DataFrame,
    shards: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
    tolerance: float = TOLERANCE,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Each row's size, CRC of its text, shard, key, and gapless place in its shard."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    keyed = store(
        documents.select(
            id_column,
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            sort_key(id_column, text).alias("key"),
        )
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = max(4, -(-total // (shards * range_bytes)))
    keys = find_splitters(keyed, total, shards * ranges, tolerance * total / shards) if total else []
    at = np.array(keys, np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, key.to_numpy(), "right").astype(np.int32))

    placed = keyed.withColumn("range", range_of("key"))
    counts = placed.groupBy("range").count()
    # one row for each range
    before = counts.select(
        "range",
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy(F.expr(f"range div {ranges}"))
                .orderBy("range")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("before"),
    )
    order = Window.partitionBy("range").orderBy("key", id_column, "text_crc32")
    numbered = placed.withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(before, "range").select(
        id_column,
        "size",
        "text_crc32",
        F.expr(f"cast(range div {ranges} as int)").alias("shard"),
        (F.col("before") + F.col("place")).cast("long").alias("slot"),
        "key",
    )
