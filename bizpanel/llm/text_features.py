"""Hashed features of texts: words, their first bytes, and buckets of a text's shape.

A feature is a number: its group in the upper bits, a hash or a bucket in the lower ones. A text has
each feature once. All counts are over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from bizpanel.llm.words import (
    ALNUM_LOWER,
    SPACED,
    U64,
    WordRule,
    Words,
    split_words,
    text_buffer,
)

HASH_BITS = 18
SPACE = 8 << HASH_BITS
SHAPE, WORD, PREFIX = 0, 1, 2
#: First bytes of a word that are features of their own; each length is a group.
PREFIX_BYTES = (4, 5, 6, 7)

_EDGES = np.array([0.0, 0.004, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
_SYMBOLS = np.isin(np.arange(256), list(b"!#$%&*|<>{}[]=+~^@_\\/`"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128)
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_LINES = WordRule(np.arange(256) != 10, np.arange(256, dtype=np.uint8))


@dataclass
class Features:
    """Features and the row of each, ordered by row; a row has each of its features once."""

    feature: np.ndarray
    row: np.ndarray
    rows: int

    def of_rows(self) -> list[bytes]:
        """The features of each row as 32-bit numbers."""
        cuts = np.searchsorted(self.row, np.arange(self.rows + 1))
        flat = self.feature.astype("<u4")
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _hashed(group: int, values: np.ndarray) -> np.ndarray:
    return (group << HASH_BITS) | (values >> U64(64 - HASH_BITS)).astype(np.int64)


def word_feature(word: str) -> int:
    """The feature of a whole word of lower case."""
    words = split_words(pa.array([word]), ALNUM_LOWER)
    return int(_hashed(WORD, words.values())[0])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _bytes_of(mask: np.ndarray, raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask[raw])))
    return total[places[1:]] - total[places[:-1]]


def _distinct(words: Words, values: np.ndarray) -> np.ndarray:
    """Different words of each text."""
    text = words.text_of
    order = np.lexsort((values, text))
    value, text = values[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[fresh], minlength=len(words.first) - 1)


def shape_shares(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Shares that describe each text's shape, and its number of words."""
    raw, places = text_buffer(texts)
    words = split_words(texts, SPACED)
    values, counts, text = words.values(), words.counts, words.text_of
    rows = len(places) - 1
    size = np.diff(places)
    again = np.zeros(len(values), bool)
    again[1:] = (values[1:] == values[:-1]) & (text[1:] == text[:-1])
    tiny = (words.end - words.start) == 1
    lines = split_words(texts, _LINES)
    shares = [
        _share(_bytes_of(_UPPER, raw, places), _bytes_of(_LETTER, raw, places)),
        _share(_bytes_of(_SYMBOLS, raw, places), size),
        _share(_bytes_of(_DIGIT, raw, places), size),
        _share(np.bincount(text, again, rows), counts),
        _share(np.bincount(text, tiny, rows), counts),
        _share(counts - _distinct(words, values), counts),
        _share(lines.counts - _distinct(lines, lines.values()), lines.counts),
    ]
    return shares, counts


def _shape_features(texts: pa.Array) -> np.ndarray:
    """One bucket for each share and for length, a row of them for each text."""
    shares, counts = shape_shares(texts)
    length = np.minimum(np.log2(counts + 1).astype(np.int64), 15)
    columns = [length]
    for k, share in enumerate(shares):
        bucket = np.searchsorted(_EDGES, share, "left")
        columns.append(16 + 16 * k + bucket)
        # long texts repeat words by nature
        columns.append(256 + 256 * k + 16 * length + bucket)
    return np.stack(columns, axis=1)


def extract(
    texts: pa.Array, prefixes: tuple[int, ...] = (), wanted: np.ndarray | None = None
) -> Features:
    """The features of each text; with ``wanted``, a mask over all features, only those."""
    words = split_words(texts, ALNUM_LOWER)
    rows = len(words.first) - 1
    text = words.text_of
    shape = _shape_features(texts)
    found = [(shape.ravel(), np.repeat(np.arange(rows), shape.shape[1]))]
    found.append((_hashed(WORD, words.values()), text))
    if prefixes:
        hasher = words.hasher()
        size = words.end - words.start
        for k, length in enumerate(prefixes):
            long = np.flatnonzero(size >= length)
            start = words.start[long]
            found.append((_hashed(PREFIX + k, hasher(start, start + length)), text[long]))
    if wanted is not None:
        found = [(f[keep], r[keep]) for f, r in found for keep in [wanted[f]]]
    feature = np.concatenate([f for f, _ in found])
    row = np.concatenate([r for _, r in found])
    joined = np.unique(row * np.int64(SPACE) + feature)
    return Features(joined % SPACE, joined // SPACE, rows)
