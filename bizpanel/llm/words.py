"""Words of many texts at once: numpy arrays over the byte buffer of an Arrow column.

Separators are ASCII in every word rule used here, so that words can be told apart byte by
byte in UTF-8. A word's 64-bit value is a polynomial over its bytes, taken from prefix sums, and
mixed; equal words have equal values in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_RADIX = 0x9E3779B97F4A7C15 | 5

#: Bytes of text that are handled together; a longer text is handled alone.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finaliser of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_GOLDEN))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, up to n."""
    if len(_powers[0]) <= n:
        size = max(2 * CHUNK_BYTES, n + 1)
        for k, base in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class SpanHasher:
    """Gives any span of a row of 64-bit symbols its value."""

    def __init__(self, symbols: np.ndarray) -> None:
        power, self._inverse = _power_tables(len(symbols))
        self._sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * power[: len(symbols)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        own = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(own + (end - start).astype(U64) * U64(_GOLDEN))


def span_values(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit value for each span of symbols; the symbols are 64-bit values themselves."""
    return SpanHasher(symbols)(start, end)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, in one array."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


@dataclass(frozen=True)
class WordRule:
    """Which bytes belong to words, and what each byte is read as."""

    keep: np.ndarray
    fold: np.ndarray


def _rule(separators: set[int], lower: bool) -> WordRule:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    keep = np.ones(256, bool)
    keep[list(separators)] = False
    return WordRule(keep[fold], fold)


_SPACES = {0x20, *range(0x09, 0x0E)}
_NOT_ALNUM = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)}
#: ``[^\x20\x09-\x0D]+`` as it stands, and with A-Z as a-z.
SPACED = _rule(_SPACES, lower=False)
SPACED_LOWER = _rule(_SPACES, lower=True)
#: What ends a piece of text for phrases; words within pieces are ``[^\x20\x09]+``.
PIECE_ENDS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
PIECE_WORDS_LOWER = _rule({0x20, 0x09, *PIECE_ENDS}, lower=True)
#: A-Z as a-z, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_LOWER = _rule(_NOT_ALNUM, lower=True)


@dataclass
class Words:
    """The words of a run of texts.

    ``data``: bytes as the rule reads them; ``start``, ``end``: places of each word in it;
    ``first``: number of the first word of each text, and at last the number of all words.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """Number of the text that holds each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hasher(self) -> SpanHasher:
        return SpanHasher(_BYTE_VALUE[self.data])

    def values(self) -> np.ndarray:
        """The 64-bit value of each word."""
        return self.hasher()(self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each text begins and the last ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int64 if wide else np.int32)
    places = places[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return flat[places[0] : places[-1]], places - places[0]


def split_words(texts: pa.Array, rule: WordRule) -> Words:
    """The words of each text."""
    raw, places = text_buffer(texts)
    data = rule.fold[raw]
    inside = rule.keep[raw]
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(places), np.int64))
    cut = np.zeros(n + 1, bool)
    cut[places] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, places))


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most so many bytes of text, or one text."""
    for batch in batches:
        texts = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(texts), 0)
        total = np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64))))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(total, total[i] + most, "right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def rolling(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """One value for each ``size`` consecutive words, over the joined words of all texts."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    radix = U64(_RADIX + 2 * seed)
    out = values[:n].copy()
    for k in range(1, size):
        out *= radix
        out += values[k : k + n]
    return mix(out + U64(seed))


def inside_text(first: np.ndarray, size: int) -> np.ndarray:
    """Whether the window that begins at each word ends in the same text."""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    end_of_text = np.repeat(first[1:], np.diff(first))
    return np.arange(size, n + size) <= end_of_text[:n]
