"""Sorted 64-bit values as few bytes: differences, cut to the bytes that the largest one needs."""

from __future__ import annotations

import numpy as np

from bizpanel.llm.words import U64


def pack(values: np.ndarray) -> bytes:
    """Ascending values, byte by byte: first all low bytes of the differences, then the next ones."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(U64), prepend=U64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The values of ``pack``."""
    if not data:
        return np.zeros(0, U64)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : data[0]] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=U64)


def split_by(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in an ascending array of bucket numbers, and where the last ends."""
    return np.searchsorted(bucket, np.arange(buckets + 1))
