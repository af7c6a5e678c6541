"""Lists of 64-bit values that go from chunks of texts to shards of the value space, and back.

A chunk is a run of texts of about ``chunk_bytes``. Its distinct values are sorted, so that the values of a
shard, a range of the value space, are one slice of them. Each list is one row; a value that is common in all texts is
in a chunk's lists once, so that no shard holds more of it than there are chunks.

There are chunks times shards rows. So that lists stay long, chunks grow with the input up to
``MOST_CHUNK_BYTES``, a bound of a task's memory; at 100 TB a list of pairs of words still has about 100 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.llm.packing import pack, unpack
from bizpanel.llm.words import U64, text_chunks

CHUNK_BYTES = 8 << 20
MOST_CHUNK_BYTES = 128 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 16 << 20
_IN_TASK = 1 << 24


def plan(documents: DataFrame, text_column: str) -> tuple[int, int]:
    """Bytes of a chunk and number of shards, from the bytes of all texts."""
    total = documents.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    chunk = min(max(CHUNK_BYTES, total >> 14), MOST_CHUNK_BYTES)
    return chunk, max(1, -(-total // SHARD_BYTES))


def chunks(
    batches: Iterator[pa.RecordBatch], column: str, most: int
) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows with about ``most`` bytes of text, or one longer text, each with a number of its own.

    The numbers depend on the task's place and its rows alone, so that a repeated task gives the same.
    """
    number = TaskContext.get().partitionId() * _IN_TASK
    held, size = [], 0
    for part in text_chunks(batches, column, most):
        if held and size + part.nbytes > 1.25 * most:
            yield number, pa.Table.from_batches(held)
            number, held, size = number + 1, [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield number, pa.Table.from_batches(held)


def starts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in ascending keys, and where the last ends."""
    return np.searchsorted((keys >> U64(32)) * U64(shards) >> U64(32), np.arange(shards + 1))


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts that are short enough to be handled at once, and the number of the first of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = 0
    for part in text_chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
        yield at, part.column("text")
        at += part.num_rows


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def put(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte: first all low bytes, then the next ones."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return _squeeze(bytes([width]) + np.ascontiguousarray(planes.T).tobytes())


def get(data: bytes) -> np.ndarray:
    """The numbers of ``put``, as int64."""
    if not data:
        return np.zeros(0, np.int64)
    data = _expand(data)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<u8").ravel().astype(np.int64)


def put_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit values."""
    return _squeeze(pack(keys)) if len(keys) else b""


def get_keys(data: bytes) -> np.ndarray:
    """The values of ``put_keys``."""
    return unpack(_expand(data)) if data else np.zeros(0, U64)


def put_lists(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Lists of so many ascending numbers each, behind each other, as differences."""
    steps = np.diff(values, prepend=0)
    first = np.cumsum(sizes) - sizes
    steps[first] = values[first]
    return put(steps)


def get_lists(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ``put_lists``."""
    steps = get(data)
    total = np.cumsum(steps)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - steps[first], sizes)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and for each the sums of its values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the place of each value among them, and how often each comes."""
    at, found = pd.factorize(values)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[at]
    return found[order], at, np.bincount(at, minlength=len(found))
