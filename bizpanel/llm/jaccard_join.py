"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are documents, columns their distinct word 5-grams. Columns are ordered from
rare to frequent by a count sketch over all documents, and ties by value. Two documents whose
similarity reaches T share a column among the first n - ceil(T n) + 1 of each, n being its size, so
that only this part of the incidence is dealt to blocks of columns. In a block:

* a column's documents are ordered by size and cut where sizes differ by more than T;
* each document is paired with one hub of its cut, not with all, and a pair goes on only if what both
  rows have from the column on suffices for the overlap that the sizes demand. Of two similar documents
  the first column that they share satisfies this; later ones need not.

Each document first takes the hub that most of its columns name. For such a pair the shared columns of both
first parts are counted; what their rests could add at most discards pairs below the size-derived bound.
The others are counted exactly, in blocks of whole rows; what is linked so becomes components. Then the
other hubs' pairs between different components follow. In further rounds each component of a column sends one
document, dealt anew by column and round, against one of the column's largest component, so that a document
that only few of a group resemble soon meets one of them. A round that links hardly any pair ends them. Last come the
columns that still hold several components, joined with themselves across components. That join gives a pair once for each run of columns that both
rows share: where the column before is shared too, the pair comes from there. So no link is lost and no
group's pairs are all made: pairs inside one component need no count. Columns that the sketch calls hot are
salted over several blocks and their cuts' first documents are paired with each other.

Exact copies of a set are joined by a digest of the set; of each such class a task sends one.

Words: A-Z as a-z, then ``[^\\x20\\x09-\\x0D]+``. With fewer than five words the whole sequence is the
only shingle.

Defined results: null and empty texts, and texts of white space, have no shingles and are linked with nothing.
Rows without id have a size and no component. Rows with the same id are one node. Extra columns
are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizpanel.llm.components import components
from bizpanel.llm.packing import pack, split_by, unpack
from bizpanel.llm.scratch import small, store
from bizpanel.llm.words import SPACED_LOWER, U64, inside_text, mix, rolling, split_words, text_chunks

SHINGLE_WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
#: Counters of the sketch, as a power of two: 16 MB in each task that counts, 8 MB in those that read it.
SKETCH_BITS = 21
#: Standard deviations above the typical counter from which a column counts as frequent.
FREQUENT = 3.0
#: Entries of a block of columns.
BLOCK_ENTRIES = 1 << 20
#: Places in a cut, evenly spread, of which each column chooses one for its hub.
HUBS = 8
#: Rounds of representatives, at most, and the share of a round's pairs that must be links for another round to
#: follow. What the rounds leave apart the last join decides.
ROUNDS = 8
WORTH = 0.02
#: Documents of a column from which it is salted.
HOT_DOCUMENTS = 50_000
#: Text of a chunk that sends its entries together.
_CHUNK = 8 << 20
#: Digests of sets that a task remembers to send a class once.
_REMEMBERED = 200_000
#: Bytes of an Arrow batch that goes to Python: rows that carry whole sets would otherwise fill 10,000-row batches
#: of any size, off the executor's heap.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_SCAN = "id long, n long, digest binary, sketch binary"
_ENTRIES = "bucket long, columns binary, rows binary, places binary, ids binary, sizes binary"
_MEMBERS = "col long, id long, n int, place int, members int, hot boolean, hub long, hub_n int"
_SETS = "id long, n int, items binary"


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending within it, and where each text's begin."""
    words = split_words(texts, SPACED_LOWER)
    values, counts = words.values(), words.counts
    grams = rolling(values, size)
    whole = inside_text(words.first, size)
    text = words.text_of
    short = np.flatnonzero((counts > 0) & (counts < size))
    single = np.zeros(len(short), U64)
    for k, t in enumerate(short):
        own = values[words.first[t] : words.first[t + 1]]
        single[k] = rolling(own, len(own), seed=100 + len(own))[0]
    value = np.concatenate((grams[whole], single))
    owner = np.concatenate((text[: len(grams)][whole], short)).astype(np.int64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def _scan(size: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for chunk in text_chunks(batches, "text"):
            values, first = shingle_sets(chunk.column("text"), size)
            np.add.at(sketch, (values >> U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            digests = [
                hashlib.blake2b(values[a:b], digest_size=16).digest() if b > a else None
                for a, b in zip(first[:-1], first[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("id"),
                    pa.array(np.diff(first)),
                    pa.array(digests, pa.binary()),
                    pa.nulls(chunk.num_rows, pa.binary()),
                ],
                schema=schema,
            )
        if sketch.any():
            last = [pa.nulls(1, pa.int64()), pa.array([-1]), pa.nulls(1, pa.binary()), pa.array([zlib.compress(sketch.astype("<u4", copy=False), 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, schema=schema)

    return run


def _sum_sketches(scan: DataFrame) -> np.ndarray:
    """The sketch over all documents: tasks add up what they read, then slices meet."""
    slices = 16
    width = (1 << SKETCH_BITS) // slices

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in batch.column("sketch").to_pylist():
                total += np.frombuffer(zlib.decompress(part), "<u4")
        parts = [total[i * width : (i + 1) * width].tobytes() for i in range(slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int64()), pa.array(parts, pa.binary())], names=["slice", "sketch"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.int64) for p in table.column("sketch").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "sketch": pa.array([total.tobytes()], pa.binary())})

    rows = (
        scan.where(F.col("sketch").isNotNull())
        .select("sketch")
        .mapInArrow(partial, "slice long, sketch binary")
        .groupBy("slice")
        .applyInArrow(add, "slice long, sketch binary")
        .collect()
    )
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in rows:
        part = np.frombuffer(row["sketch"], np.int64)
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.minimum(part, 0xFFFFFFFF)
    return out


@dataclass(frozen=True)
class _Layout:
    size: int
    percent: int
    buckets: int
    bits: int
    hot: int
    sketch: np.ndarray

    def counts(self, values: np.ndarray) -> np.ndarray:
        """What the sketch says of each column's documents, at least."""
        return self.sketch[(values >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)

    @cached_property
    def counter_ranks(self) -> np.ndarray:
        """The rank of each counter's columns, up to 255."""
        typical = max(float(np.median(self.sketch)), 1.0)
        over = (self.sketch - typical) / math.sqrt(typical)
        return np.where(over < FREQUENT, 0, 1 + np.round(4 * np.log2(np.maximum(over, 1)))).astype(np.uint8)

    def ranks(self, values: np.ndarray) -> np.ndarray:
        """0 for columns whose counter is as full as most, and more for frequent ones."""
        return self.counter_ranks[(values >> U64(64 - SKETCH_BITS)).astype(np.int64)]

    def demanded(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The least overlap of similar sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def can_begin(self, n, i, m, j) -> np.ndarray:
        """Whether rows whose first shared column is at places i and j can overlap as their sizes demand."""
        return np.minimum(n - i, m - j) >= self.demanded(n, m)


def _prefixes(values: np.ndarray, first: np.ndarray, layout: _Layout):
    """Entries that have to be sent: value, row, place in the row."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, row * 256 + layout.ranks(values)))
    place = np.arange(len(values)) - first[row]
    keep = place < (n - -(-layout.percent * n // 100) + 1)[row]
    return values[order[keep]], row[keep], place[keep]


def _send(layout: _Layout):
    names = ["bucket", "columns", "rows", "places", "ids", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for chunk in text_chunks(batches, "text", _CHUNK):
            ids = chunk.column("id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            n, parts, before = np.zeros(len(ids), np.int64), [], 0
            for piece in text_chunks(iter([chunk]), "text"):
                values, first = shingle_sets(piece.column("text"), layout.size)
                after = before + piece.num_rows
                n[before:after] = np.diff(first)
                own = known[before:after]
                for t in np.flatnonzero(own):
                    digest = hashlib.blake2b(values[first[t] : first[t + 1]], digest_size=16).digest()
                    own[t] = digest not in seen
                    seen.add(digest)
                value, row, place = _prefixes(values, first, layout)
                del values
                sent = own[row]
                parts.append((value[sent], row[sent] + before, place[sent]))
                before = after
            if len(seen) > _REMEMBERED:
                seen = set()
            value, row, place = map(np.concatenate, zip(*parts))
            parts.clear()
            bucket = ((value >> U64(32)) * U64(layout.buckets) >> U64(32)).astype(np.int64)
            salts = np.maximum(layout.counts(value) // layout.hot, 1)
            salt = (mix(ids[row].astype(U64)) % salts.astype(U64)).astype(np.int64)
            bucket = (bucket + salt * 7919) % layout.buckets
            order = np.lexsort((value, bucket))
            value, row, place, bucket = value[order], row[order], place[order], bucket[order]
            cuts = split_by(bucket, layout.buckets)
            out: list[list] = [[] for _ in names]
            for b in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[b], cuts[b + 1])
                rows, local = np.unique(row[own], return_inverse=True)
                order = np.argsort(ids[rows], kind="stable")
                rank = np.empty(len(rows), np.int64)
                rank[order] = np.arange(len(rows))
                packed = (
                    int(b),
                    pack(value[own] >> U64(64 - layout.bits)),
                    rank[local].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
                    place[own].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
                    ids[rows][order].astype("<i8").tobytes(),
                    n[rows][order].astype("<u4").tobytes(),
                )
                for column, part in zip(out, packed):
                    column.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=names
            )

    return run


def _planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _block(layout: _Layout):
    """Columns of a block with several documents, and the hub of each document's cut."""
    schema = pa.schema(
        [("col", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("place", pa.int32()),
         ("members", pa.int32()), ("hot", pa.bool_()), ("hub", pa.int64()), ("hub_n", pa.int32())]
    )

    def run(table: pa.Table) -> pa.Table:
        columns, docs, sizes, places = [], [], [], []
        for part in table.to_pylist():
            rows = _planes(part["rows"])
            columns.append(unpack(part["columns"]))
            docs.append(np.frombuffer(part["ids"], "<i8")[rows])
            sizes.append(np.frombuffer(part["sizes"], "<u4")[rows].astype(np.int64))
            places.append(_planes(part["places"]))
        col, doc, n, place = map(np.concatenate, (columns, docs, sizes, places))
        order = np.argsort(col, kind="stable")
        col = col[order]
        same = np.zeros(len(col) + 1, bool)
        same[1:-1] = col[1:] == col[:-1]
        # documents of a hot column may meet in another block
        several = same[1:] | same[:-1] | (layout.counts(col << U64(64 - layout.bits)) >= 2 * layout.hot)
        order, col = order[several], col[several]
        doc, n, place = doc[order], n[order], place[order]
        order = np.lexsort((doc, n, col))
        col, doc, n, place = col[order], doc[order], n[order], place[order]
        start = np.zeros(len(col), bool)
        start[:1] = True
        start[1:] = col[1:] != col[:-1]
        members = np.diff(np.append(np.flatnonzero(start), len(col)))
        members = np.repeat(members, members)
        while True:
            hub = np.flatnonzero(start)[np.cumsum(start) - 1] if len(col) else np.zeros(0, np.int64)
            far = 100 * n[hub] < layout.percent * n
            new = far & ~np.concatenate(([False], far[:-1] & ~start[1:]))
            if not new.any():
                break
            start |= new
        cut = np.cumsum(start) - 1
        length = np.bincount(cut)
        hub = hub + (mix(col) % U64(HUBS)).astype(np.int64) * length[cut] // HUBS
        fits = (doc != doc[hub]) & layout.can_begin(n, place, n[hub], place[hub])
        counts = layout.counts(col << U64(64 - layout.bits))
        return pa.table(
            [
                pa.array(col.astype(np.int64)),
                pa.array(doc),
                pa.array(n.astype(np.int32)),
                pa.array(place.astype(np.int32)),
                pa.array(members.astype(np.int32)),
                pa.array(counts >= 2 * layout.hot),
                pa.array(doc[hub], mask=~fits),
                pa.array(n[hub].astype(np.int32), mask=~fits),
            ],
            schema=schema,
        )

    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            values, first = shingle_sets(chunk.column("text"), size)
            packed = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(np.diff(first).astype(np.int32)), pa.array(packed, pa.binary())],
                schema=schema,
            )

    return run


def _count_overlaps(percent: int):
    """Rows of the product: all partners of one document against its column of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            left, right = batch.column("items_a"), batch.column("items_b")
            linked = np.zeros(len(a), bool)
            run_start = np.flatnonzero(np.diff(b, prepend=~b[:1]) != 0)
            for lo, hi in zip(run_start, np.append(run_start[1:], len(b))):
                column = right[lo].as_py()
                hub = np.frombuffer(column, U64)
                same = [i for i in range(lo, hi) if right[i].as_py() == column]
                rest = [i for i in range(lo, hi) if i not in set(same)] if len(same) < hi - lo else []
                rows = [np.frombuffer(left[i].as_py(), U64) for i in same]
                sizes = np.array([len(r) for r in rows])
                flat = np.concatenate(rows)
                place = np.minimum(np.searchsorted(hub, flat), len(hub) - 1)
                overlap = np.add.reduceat(hub[place] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
                linked[same] = 100 * overlap >= percent * (sizes + len(hub) - overlap)
                for i in rest:
                    x, y = np.frombuffer(left[i].as_py(), U64), np.frombuffer(right[i].as_py(), U64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], names=["a", "b"])

    return run


def _promising(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, n, b, m) that share enough columns for similar sets of their sizes: a, b, shared.

    A pair overlaps in the columns that both first parts share, and beyond them in no more than the rest of
    that row whose first part ends earlier.
    """
    ids = store(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    needed = members.select("id", "col").join(small(ids, 16), "id", "left_semi")
    columns = needed.groupBy("id").agg(F.collect_set("col").alias("cols"))
    shared = F.size(F.array_intersect("cols_a", "cols_b"))
    rest = F.greatest(F.expr(f"({percent} * n + 99) div 100"), F.expr(f"({percent} * m + 99) div 100")) - 1
    both = pairs.join(columns.toDF("a", "cols_a"), "a").join(columns.toDF("b", "cols_b"), "b")
    enough = (100 + percent) * (shared + rest) >= percent * (F.col("n") + F.col("m"))
    return both.where(enough).groupBy("a", "b").agg(F.max(shared).alias("shared"))


def _links(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose sets are similar; b is the side that many pairs share."""
    pairs = store(pairs.select("a", "b"))
    ids = store(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    needed = rows.join(small(ids, 16), "id", "left_semi")
    sets = store(needed.mapInArrow(_sets(size), _SETS))
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    other = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    whole = pairs.join(one, "a").join(other, "b").select("a", "b", "items_a", "items_b")
    return store(whole.mapInArrow(_count_overlaps(percent), "a long, b long").distinct())


def _representatives(labelled: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, n, b, m): of each component of a column one row, with one of the column's largest component.

    Both are dealt by hash of the column and the turn. Columns whose components are single rows give none,
    and neither do rows of sizes that cannot be similar. Any column will do here, not the first shared one alone.
    """
    dealt = F.xxhash64("id", "col", F.lit(turn)).alias("dealt")
    parts = labelled.groupBy("col", "component").agg(
        F.count("*").alias("k"), F.min(F.struct(dealt, "id", "n")).alias("x")
    )
    parts = store(parts)
    largest = parts.groupBy("col").agg(F.max(F.struct("k", "component", F.col("x").alias("y"))).alias("top"), F.count("*").alias("c"))
    largest = largest.where("c > 1 AND top.k > 1").select("col", "top.component", "top.y").toDF("col", "other", "y")
    return (
        parts.join(largest, "col")
        .where(F.col("component") != F.col("other"))
        .where(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        .select(F.col("x.id").alias("a"), F.col("x.n"), F.col("y.id").alias("b"), F.col("y.n").alias("m"))
        .distinct()
    )


def _relabel(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """The stored rows of columns under the components that the links make of theirs."""
    of = labelled.select("id", "component").distinct()
    ends = links.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b")
    up = store(components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    moved = labelled.join(small(up.toDF("component", "top"), 16), "component", "left")
    return store(moved.select("col", "id", "n", "place", F.coalesce("top", "component").alias("component")))


def similar_links(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    hot: int = HOT_DOCUMENTS,
) -> tuple[DataFrame, DataFrame]:
    """Sizes and digests of all sets (id, n, digest), and links (a, b) that join all similar documents.

    Any two similar documents are connected by the links, though not always by a link of their own.
    Meanwhile Arrow batches hold at most BATCH_BYTES; all that is made here is stored before it ends.
    """
    spark = documents.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return _similar_links(documents, id_column, text_column, size, percent, hot)
    finally:
        spark.conf.set(_BATCH, before)


def _similar_links(
    documents: DataFrame, id_column: str, text_column: str, size: int, percent: int, hot: int
) -> tuple[DataFrame, DataFrame]:
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    scan = store(rows.mapInArrow(_scan(size), _SCAN))
    found = scan.where(F.col("n") >= 0).select("id", "n", "digest")
    total = found.agg(F.sum("n")).first()[0] or 0
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = total * (100 - percent) // 100
    bits = min(64, max(SKETCH_BITS + 6, math.ceil(math.log2(max(sent, 2))) + 7))
    layout = _Layout(size, percent, max(least, sent // BLOCK_ENTRIES), bits, hot, _sum_sketches(scan))
    layout.counter_ranks  # once here, not once in each task
    entries = rows.mapInArrow(_send(layout), _ENTRIES)
    members = store(entries.groupBy("bucket").applyInArrow(_block(layout), _MEMBERS))
    salted = members.where(F.col("hot") & F.col("hub").isNull())
    lowest = salted.groupBy("col").agg(F.min(F.struct("n", "id")).alias("top"))
    across = salted.join(lowest, "col").where(F.col("id") != F.col("top.id"))
    first = members.where(F.col("hub").isNotNull())
    named = first.select("id", "n", "hub", "hub_n").union(across.select("id", "n", "top.id", "top.n"))
    pairs = store(named.toDF("a", "n", "b", "m").groupBy("a", "n", "b", "m").agg(F.count("*").alias("votes")))
    copies = found.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    lead = copies.groupBy("digest").agg(F.min("id").alias("a"), F.count("*").alias("k"))
    exact = store(
        copies.join(lead.where(F.col("k") > 1), "digest")
        .where(F.col("id") != F.col("a"))
        .select("a", F.col("id").alias("b"))
    )
    best = pairs.groupBy("a").agg(F.max(F.struct("votes", -F.col("b"), "n", "b", "m")).alias("top"))
    best = store(best.select("a", "top.n", "top.b", "top.m"))
    linked = _links(_promising(best, members, percent), rows, size, percent).union(exact)
    so_far = store(components(linked))
    of_a, of_b = so_far.toDF("a", "of_a"), so_far.toDF("b", "of_b")
    apart = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    apart = store(apart.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "n", "b", "m"))
    linked = linked.union(_links(_promising(apart, members, percent), rows, size, percent))
    so_far = store(components(linked))

    # each task sends one row of a class of equal sets; from here on one of them stands for all
    classes = members.select("id").distinct().join(exact.select(F.col("b").alias("id"), "a"), "id", "left")
    kept = classes.groupBy(F.coalesce("a", "id").alias("lead")).agg(F.min("id").alias("first"))
    spare = classes.join(kept, F.coalesce("a", "id") == F.col("lead")).where(F.col("id") != F.col("first"))
    spare = store(spare.select("id"))
    single = members.join(small(spare, 8), "id", "left_anti")
    open_columns = single.where((F.col("members") > 2) | F.col("hot")).select("col", "id", "n", "place")
    labelled = open_columns.join(so_far.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    labelled = store(labelled.select("col", "id", "n", "place", "component"))
    for turn in range(ROUNDS):
        met = store(_representatives(labelled, turn, percent))
        links = _links(_promising(met, members, percent), rows, size, percent)
        known = links.count()
        if known:
            linked = linked.union(links)
            labelled = _relabel(labelled, links)
        if known <= WORTH * met.count():
            break
    mixed = (
        labelled.groupBy("col")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where(F.col("lo") < F.col("hi"))
        .select("col")
    )
    before = F.lag("col").over(Window.partitionBy("id", "n").orderBy("place", "col"))
    left = store(labelled.join(mixed, "col", "left_semi").withColumn("before", before))
    x, y = left.alias("x"), left.alias("y")
    overlap = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    run_begins = F.col("x.before").isNull() | ~F.col("x.before").eqNullSafe(F.col("y.before"))
    across = (
        x.join(y, F.col("x.col") == F.col("y.col"))
        .where(F.col("x.component") < F.col("y.component"))
        .where(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        .where((100 + percent) * overlap >= percent * (F.col("x.n") + F.col("y.n")))
        .where(run_begins)
        .select(F.col("x.id").alias("a"), F.col("x.n"), F.col("y.id").alias("b"), F.col("y.n").alias("m"))
        .distinct()
    )
    more = _links(_promising(store(across), members, percent), rows, size, percent)
    return found, linked.union(more)


def similar_components(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    hot: int = HOT_DOCUMENTS,
) -> DataFrame:
    """Each document's number of shingles and the smallest id it reaches over similar documents."""
    found, links = similar_links(documents, id_column, text_column, size, percent, hot)
    reached = components(links).withColumnRenamed("node", "id")
    return found.join(reached, "id", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )
