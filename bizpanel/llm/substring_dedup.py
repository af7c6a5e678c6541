"""Substring dedup by fixed-block anchors.

Texts are dealt to groups by a hash. A window of W words always holds a whole block of B = (W + 1) // 2
words among the non-overlapping blocks of its document. So:

1. Each group sends its reference blocks (at words 0, B, 2B, ...) and its rolling windows of B words,
   as short fingerprints in sorted packed form, to buckets by fingerprint. A bucket answers each group with
   the anchors it shares with another group, where one side has it as a block.
2. Where anchors are shared, with another group or inside the group, hits are extended: every window
   of W words around them goes, by its 64-bit value, to buckets with the smallest id that holds it in the
   group. A bucket answers with the windows that a smaller id holds elsewhere.
3. Each group marks the windows whose value a smaller id holds, here or elsewhere. Neighbouring
   marked windows join to maximal repeats; their words are removed.

What a group knows itself is settled there, so that a passage in a third of all documents reaches a bucket
once per group. Fingerprints only choose candidates: their bits follow the input's bytes, and a
chance hit costs work, not correctness. Windows are compared by 64-bit values.

Words: ``[^\\x20\\x09-\\x0D]+`` as they stand.

Defined results: null and empty texts have no words and keep an empty text. Rows with a null id lose
nothing and take nothing from others. Rows with the same id take nothing from each other. Extra
columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizpanel.llm.packing import pack, split_by, unpack
from bizpanel.llm.words import SPACED, U64, inside_text, rolling, split_words, text_chunks

#: Words of a window that has to be repeated.
WINDOW_WORDS = 13
#: Bytes of text of a group and of the text behind a bucket; to be raised with executor memory.
GROUP_BYTES = 8 << 20
_SEED = 7
_ANCHORS = "grp long, bucket long, blocks binary, rolling binary"
_SHARED = "grp long, anchors binary"
_WINDOWS = "grp long, bucket long, windows binary, ids binary"
_REPEATED = "grp long, windows binary"
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class _Layout:
    """Sizes that all steps agree on."""

    window: int
    block: int
    groups: int
    buckets: int
    bits: int


def _layout(total: int, window: int, least: int, group_bytes: int) -> _Layout:
    """One anchor in about a hundred may hit by chance, whatever the bytes."""
    groups = max(least, math.ceil(total / group_bytes))
    buckets = max(least, math.ceil(total / (2 * group_bytes)))
    block = (window + 1) // 2
    bits = min(64, max(24, math.ceil(math.log2(max(total, 2) / block)) + 5))
    return _Layout(window, block, groups, buckets, bits)


@dataclass
class _Text:
    """The words of a group's texts, in the order of its rows."""

    values: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Values of all windows of one size, and whether each lies in one text."""
        return rolling(self.values, size, seed), inside_text(self.first, size)


def _read(texts: pa.Array) -> _Text:
    values, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for chunk in text_chunks(iter([batch]), "text"):
        words = split_words(chunk.column("text"), SPACED)
        values.append(words.values())
        counts.append(words.counts)
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    return _Text(np.concatenate(values), first)


def _rows(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids (the largest number for null) and texts."""
    ids = table.column("id").fill_null(_NO_ID).to_numpy()
    return ids, table.column("text").combine_chunks()


def _spread(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each value, ascending as the values are."""
    return ((values >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _anchor_values(text: _Text, ids: np.ndarray, layout: _Layout) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the rolling window at each word, and whether one begins there."""
    values, whole = text.windows(layout.block)
    long_enough = (np.diff(text.first) >= layout.window) & (ids != _NO_ID)
    return values & ~(U64((1 << (64 - layout.bits)) - 1)), whole & long_enough[text.row[: len(values)]]


def _packed_rows(group: int, layout: _Layout, columns: list[np.ndarray], bits: int = 64) -> dict:
    """Each bucket's part of ascending values, packed."""
    shift = U64(64 - bits)
    cuts = [split_by(_spread(c, layout.buckets), layout.buckets) for c in columns]
    full = np.flatnonzero(sum(np.diff(c) for c in cuts))
    parts = [
        [pack(column[cut[b] : cut[b + 1]] >> shift) for b in full] for column, cut in zip(columns, cuts)
    ]
    return {"grp": np.full(len(full), group), "bucket": full, "parts": parts, "cuts": cuts}


def _send_anchors(layout: _Layout):
    schema = pa.schema(
        [("grp", pa.int64()), ("bucket", pa.int64()), ("blocks", pa.binary()), ("rolling", pa.binary())]
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, texts = _rows(table)
        text = _read(texts)
        values, whole = _anchor_values(text, ids, layout)
        at = np.arange(len(values)) - text.first[text.row[: len(values)]]
        blocks = np.unique(values[whole & (at % layout.block == 0)])
        others = np.setdiff1d(values[whole], blocks)
        rows = _packed_rows(key[0].as_py(), layout, [blocks, others], layout.bits)
        return pa.table([pa.array(rows["grp"]), pa.array(rows["bucket"]), *map(pa.array, rows["parts"])], schema=schema)

    return run


def _share_anchors(layout: _Layout):
    schema = pa.schema([("grp", pa.int64()), ("anchors", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        groups = table.column("grp").to_numpy()
        values, owners, is_block = [], [], []
        for g, blocks, others in zip(groups, table.column("blocks").to_pylist(), table.column("rolling").to_pylist()):
            for packed, kind in ((blocks, True), (others, False)):
                part = unpack(packed)
                values.append(part)
                owners.append(np.full(len(part), g))
                is_block.append(np.full(len(part), kind))
        value, owner, block = map(np.concatenate, (values, owners, is_block))
        order = np.argsort(value, kind="stable")
        value, owner, block = value[order], owner[order], block[order]
        first = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0) if len(value) else np.zeros(0, np.int64)
        size = np.diff(first, append=len(value))
        # a group sends an anchor once, so that two rows are two groups
        shared = np.repeat((size > 1) & np.logical_or.reduceat(block, first), size) if len(first) else block
        value, owner = value[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
        found = np.unique(owner)
        cuts = np.searchsorted(owner, np.append(found, owner[-1:] + 1))
        packed = [pack(value[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table([pa.array(found, pa.int64()), pa.array(packed, pa.binary())], schema=schema)

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value stands in the ascending ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values


def _repeated(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The values that stand more than once among the chosen ones, ascending."""
    own = np.sort(values[chosen])
    return np.unique(own[1:][own[1:] == own[:-1]])


def _least_ids(text: _Text, ids: np.ndarray, layout: _Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window values, whether each counts, and the id of each window's document."""
    values, whole = text.windows(layout.window, _SEED)
    owner = ids[text.row[: len(values)]]
    return values, whole & (owner != _NO_ID), owner


def _send_windows(layout: _Layout):
    schema = pa.schema(
        [("grp", pa.int64()), ("bucket", pa.int64()), ("windows", pa.binary()), ("ids", pa.binary())]
    )

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _rows(left)
        text = _read(texts)
        anchors, whole = _anchor_values(text, ids, layout)
        foreign = [unpack(p) << U64(64 - layout.bits) for p in right.column("anchors").to_pylist()]
        hits = np.sort(np.concatenate([np.zeros(0, U64), *foreign]))
        marked = np.zeros(len(text.values) + 1, np.int64)
        marked[1 : len(anchors) + 1] = whole & _among(anchors, hits)
        marked[len(anchors) + 1 :] = 0
        before = np.cumsum(marked)
        values, counts, owner = _least_ids(text, ids, layout)
        last = np.arange(len(values)) + layout.window - layout.block + 1
        near = counts & (before[np.minimum(last, len(before) - 1)] > before[: len(values)])
        order = np.lexsort((owner[near], values[near]))
        value, least = values[near][order], owner[near][order]
        first = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0) if len(value) else np.zeros(0, np.int64)
        rows = _packed_rows(key[0].as_py() if key else 0, layout, [value[first]])
        cut, least = rows["cuts"][0], least[first].astype("<i8")
        planes = [
            np.ascontiguousarray(least[cut[b] : cut[b + 1]].view(np.uint8).reshape(-1, 8).T).tobytes()
            for b in rows["bucket"]
        ]
        return pa.table(
            [pa.array(rows["grp"]), pa.array(rows["bucket"]), pa.array(rows["parts"][0], pa.binary()), pa.array(planes, pa.binary())],
            schema=schema,
        )

    return run


def _answer_windows():
    schema = pa.schema([("grp", pa.int64()), ("windows", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        values, ids, owners = [], [], []
        for g, packed, planes in zip(*(table.column(c).to_pylist() for c in ("grp", "windows", "ids"))):
            part = unpack(packed)
            values.append(part)
            ids.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel())
            owners.append(np.full(len(part), g))
        value, least, owner = map(np.concatenate, (values, ids, owners))
        order = np.argsort(value, kind="stable")
        value, least, owner = value[order], least[order], owner[order]
        first = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0)
        lowest = np.repeat(np.minimum.reduceat(least, first), np.diff(first, append=len(value)))
        late = least > lowest
        value, owner = value[late], owner[late]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
        found = np.unique(owner)
        cuts = np.searchsorted(owner, np.append(found, owner[-1:] + 1))
        packed = [pack(value[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table([pa.array(found, pa.int64()), pa.array(packed, pa.binary())], schema=schema)

    return run


def _mark(text: _Text, ids: np.ndarray, elsewhere: np.ndarray, layout: _Layout) -> np.ndarray:
    """Whether each word is covered by a window that a smaller id holds."""
    values, counts, owner = _least_ids(text, ids, layout)
    repeated = counts & _among(values, elsewhere)
    twice = np.flatnonzero(counts & _among(values, _repeated(values, counts)))
    if len(twice):
        order = twice[np.argsort(values[twice], kind="stable")]
        value = values[order]
        first = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0)
        lowest = np.minimum.reduceat(owner[order], first)
        repeated[order] |= owner[order] > np.repeat(lowest, np.diff(first, append=len(order)))
    step = np.zeros(len(text.values) + 1, np.int64)
    at = np.flatnonzero(repeated)
    step[at] += 1
    np.add.at(step, at + layout.window, -1)
    return np.cumsum(step[:-1]) > 0


def _clean(layout: _Layout, digests: bool):
    names = ["n_words", "n_removed", "kept_sha256" if digests else "kept_text", "removed"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def columns_of(texts: pa.Array, marked: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        out, removed, spans_of, row = [], [], [], 0
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for chunk in text_chunks(iter([batch]), "text"):
            words = split_words(chunk.column("text"), SPACED)
            data = words.data.tobytes()
            start, end = words.start.tolist(), words.end.tolist()
            for i in range(chunk.num_rows):
                own = marked[first[row] : first[row + 1]]
                a, b = int(words.first[i]), int(words.first[i + 1])
                if digests or own.any():
                    kept = (np.flatnonzero(~own) + a).tolist() if own.any() else range(a, b)
                    joined = b" ".join([data[start[k] : end[k]] for k in kept])
                    out.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
                else:
                    out.append(chunk.column("text")[i].as_py() or "")
                edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                spans_of.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
                removed.append(int(own.sum()))
                row += 1
        return [
            pa.array(np.diff(first)),
            pa.array(removed, pa.int64()),
            pa.array(out, pa.string()),
            pa.array(spans_of, spans),
        ]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _rows(left)
        text = _read(texts)
        elsewhere = [unpack(p) for p in right.column("windows").to_pylist()]
        known = np.sort(np.concatenate([np.zeros(0, U64), *elsewhere]))
        found = columns_of(texts, _mark(text, ids, known, layout), text.first)
        return pa.table([left.column("rest"), *found], names=["rest", *names])

    return run


def remove_repeats(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW_WORDS,
    digests: bool = False,
    group_bytes: int = GROUP_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """For each document its words, the removed ones and their spans, and the kept text.

    The kept text is the kept words joined by one space, and a text that loses nothing as it stands; with
    ``digests`` it is the SHA-256 of the kept words joined by one space. ``carry`` names further columns
    of the documents that come back with each row.
    """
    spark = documents.sparkSession
    total = documents.agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = _layout(total, window, least, group_bytes)
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        F.struct(id_column, *carry).alias("rest"),
    )
    texts = rows.withColumn("grp", F.pmod(F.xxhash64("id", "text"), F.lit(layout.groups)))
    by_group = texts.groupBy("grp")
    anchors = by_group.applyInArrow(_send_anchors(layout), _ANCHORS)
    shared = anchors.groupBy("bucket").applyInArrow(_share_anchors(layout), _SHARED)
    windows = by_group.cogroup(shared.groupBy("grp")).applyInArrow(_send_windows(layout), _WINDOWS)
    repeated = windows.groupBy("bucket").applyInArrow(_answer_windows(), _REPEATED)
    found = T.StructType.fromDDL(
        f"n_words long, n_removed long, {'kept_sha256' if digests else 'kept_text'} string, "
        "removed array<struct<start:long,end:long>>"
    )
    schema = T.StructType([rows.schema["rest"], *found])
    cleaned = by_group.cogroup(repeated.groupBy("grp")).applyInArrow(_clean(layout, digests), schema)
    return cleaned.select("rest.*", *found.names)
