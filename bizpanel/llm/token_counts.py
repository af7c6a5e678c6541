"""Token counts by section: whole documents are encoded once and tokens mapped by offset.

A document is encoded as one text, so that no token is made that the whole text does not have. The
byte lengths of the tokens give their spans; character spans follow from the bytes that begin a
character. Sections partition the text: each runs from the end of the last separator to the end of
its own. Token spans are joined with sections by interval, and a token that crosses a boundary is
allocated by one of these rules:

* ``majority``: to the section with most of its bytes, the earliest of equals (the default);
* ``start``: to the section of its first byte;
* ``split``: by bytes, as fractions of a token.

Under each rule a document's sections add up to its tokens.

Defined results: a null or empty text has no tokens and one empty section 0. Ids pass through, null
and repeated ones too. Extra columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.llm.words import text_buffer, text_chunks

RULES = ("majority", "start", "split")
_DDL = (
    "id long, section_no long, char_start long, char_end long, "
    "n_tokens double, n_crossing long, n_doc_tokens long"
)
_SCHEMA = pa.schema(
    [(name, pa.float64() if name == "n_tokens" else pa.int64()) for name in
     ("id", "section_no", "char_start", "char_end", "n_tokens", "n_crossing", "n_doc_tokens")]
)


class ByteEncoder:
    """A byte-level BPE of a rank file; ``lengths`` has the bytes of each token."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


def section_ends(data: np.ndarray, separator: int) -> np.ndarray:
    """Where each section ends, in bytes: after each run of separators, and at the end."""
    is_separator = data == separator
    after = np.flatnonzero(is_separator[:-1] & ~is_separator[1:]) + 1
    return np.append(after, len(data))


def allocate(ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section."""
    n = len(sections)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(sections, starts, "right")
    last = np.searchsorted(sections, ends, "left")
    crossing = np.flatnonzero(first != last)
    if rule == "start" or not len(crossing):
        tokens = np.bincount(first, minlength=n).astype(np.float64)
    else:
        tokens = np.bincount(first[first == last], minlength=n).astype(np.float64)
    touched = np.zeros(n, np.int64)
    opens = np.concatenate(([0], sections[:-1]))
    for t in crossing:
        own = np.arange(first[t], last[t] + 1)
        touched[own] += 1
        part = np.minimum(sections[own], ends[t]) - np.maximum(opens[own], starts[t])
        if rule == "majority":
            tokens[own[np.argmax(part)]] += 1
        elif rule == "split":
            tokens[own] += part / part.sum()
    return tokens, touched


def _counter(path: str, pattern: str, separator: int, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(path, pattern)
        for chunk in text_chunks(batches, "text"):
            data, places = text_buffer(chunk.column("text"))
            begins_char = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            sizes = np.zeros(chunk.num_rows, np.int64)
            for i, text in enumerate(chunk.column("text").to_pylist()):
                own = data[places[i] : places[i + 1]]
                sections = section_ends(own, separator) if len(own) else np.zeros(1, np.int64)
                ends = encoder.ends(text) if text else np.zeros(0, np.int64)
                tokens, touched = allocate(ends, sections, rule)
                chars = begins_char[places[i] + sections] - begins_char[places[i]]
                sizes[i] = len(sections)
                for column, part in zip(
                    columns,
                    (
                        np.arange(len(sections)),
                        np.concatenate(([0], chars[:-1])),
                        chars,
                        tokens,
                        touched,
                        np.full(len(sections), len(ends)),
                    ),
                ):
                    column.append(part)
            ids = chunk.column("id").take(pa.array(np.repeat(np.arange(chunk.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(np.concatenate(c)) for c in columns)], schema=_SCHEMA
            )

    return run


def section_tokens(
    documents: DataFrame,
    rank_file: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    separator: str = "\n",
    rule: str = "majority",
) -> DataFrame:
    """One row per document and section with its characters, tokens and crossing tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if len(separator.encode()) != 1:
        raise ValueError("the separator is one ASCII character")
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    counted = rows.mapInArrow(_counter(rank_file, pattern, ord(separator), rule), _DDL)
    return counted.withColumnRenamed("id", id_column)
