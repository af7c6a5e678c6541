"""Exact top-k by inner product with MaxScore.

The terms of a query are the dimensions, and a shard of vectors keeps for each dimension the posting
column of its values with its smallest and largest one. A dimension adds at most its score bound to
a query's score. Per query and shard the dimensions are ordered by bound; the essential ones are
those before the remaining bounds could lift no vector over the threshold alone. Essential
columns are traversed for all vectors of the shard; further ones are probed only for vectors whose
score so far plus the remaining bounds still reaches the query's k-th best. Shards' results merge
by score.

Vectors are dealt to shards by a hash. Queries are packed in blocks, and blocks make lanes; every block goes to every
shard by shuffle, and a task takes one shard and one lane at a time. No side is broadcast: what all shards together
read of the queries is many times what Spark measures before the blocks are repeated. Shards grow with the table up to
GROUP_BYTES, so that the repeated blocks grow in proportion to it until then. Arithmetic is in float64 over integers, which
is exact below 2^53; a shard and block that could exceed that are computed in whole numbers of any size.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without id.
Vectors of different length are kept apart by length. Of rows with the same id each takes part; none answers
a query of its own id. Query rows with the same id each get a ranking of their own. Components beyond 64 bits and scores
beyond them count as, and come out as, the nearest 64-bit number. Extra columns are dropped. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard, at least where there are so many, and queries of a block.
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Shards of a table, as long as their vectors and the queries of a lane stay below so many bytes in 64-bit numbers.
SHARDS = 128
GROUP_BYTES = 16 << 20
#: Dimensions that are traversed or probed at once.
STEP = 8
_NAMES = ("query_id", "query_row", "vec_id", "score")
_HITS = ", ".join(f"{name} long" for name in _NAMES)
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """Vectors as floor(scale * x), without those that take no part."""
    v = F.col(vector_column)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & sound).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )


def maxscore(
    queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places and scores of the shard's k best, ties to smaller ids.

    ``vectors`` has the ids in ascending order; ``own`` are the queries' ids.
    """
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    columns = np.ascontiguousarray(vectors.T)
    found = []
    for number, q in enumerate(queries):
        # each dimension adds between floor and floor + bound
        ends = np.stack((q * low, q * high))
        floor, bound = ends.min(axis=0), np.ptp(ends, axis=0)
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0.0]))
        alive = np.flatnonzero(ids != own[number])
        if not len(alive):
            found.append((number, alive, np.zeros(0)))
            continue
        score = np.full(len(alive), floor.sum())
        done = 0
        while done < len(order):
            dims = order[done : done + STEP]
            part = columns[dims] if len(alive) == len(ids) else columns[np.ix_(dims, alive)]
            score = score + q[dims] @ part - floor[dims].sum()
            done += len(dims)
            if len(score) > k:
                threshold = np.partition(score, -k)[-k]
                # a vector's later dimensions add at least 0 to its score so far
                keep = score + rest[done] >= threshold
                if not keep.all():
                    alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        found.append((number, alive[best], score[best]))
    return found


def large_scores(
    queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> list[tuple[int, np.ndarray, list[int]]]:
    """As ``maxscore``, in whole numbers of any size, without bounds."""
    wide = vectors.astype(object)
    found = []
    for number, q in enumerate(queries.astype(object)):
        score = wide.dot(q)
        alive = np.flatnonzero(ids != own[number]).tolist()
        best = heapq.nsmallest(k, alive, key=lambda i: (-score[i], ids[i]))
        found.append((number, np.array(best, np.int64), [score[i] for i in best]))
    return found


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes that hold all of them."""
    low, high = numbers.min(initial=0), numbers.max(initial=0)
    kinds = (np.dtype(f"i{n}") for n in (1, 2, 4, 8))
    return numbers.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def _matrix(packed: bytes, rows: int, size: int) -> np.ndarray:
    width = len(packed) // (rows * size) if rows * size else 8
    return np.frombuffer(packed, f"i{width}").reshape(rows, size).astype(np.int64)


def _most(matrix: np.ndarray) -> float:
    return float(np.abs(matrix.astype(np.float64)).max(initial=0))


def _pack(frame: DataFrame, key: str) -> DataFrame:
    """Vectors of one key in one row."""

    def pack(table: pa.Table) -> pa.Table:
        flat = pc.list_flatten(table.column("vector")).to_numpy()
        return pa.table(
            {
                key: table.column(key)[:1],
                "size": table.column("size")[:1],
                "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()),
                "rows": pa.array([table.column("row").to_numpy().tobytes()], pa.binary()),
                "data": pa.array([_narrow(flat).tobytes()], pa.binary()),
            }
        )

    return frame.groupBy(key, "size").applyInArrow(
        pack, f"{key} long, size int, ids binary, rows binary, data binary"
    )


def _search(vectors: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """The k best of a shard's vectors for each query of the blocks."""
    columns: dict[str, list[np.ndarray]] = {name: [np.zeros(0, np.int64)] for name in _NAMES}
    if len(vectors):
        ids = vectors.column("vec_id").to_numpy()
        data = pc.list_flatten(vectors.column("vector")).to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, data = ids[order], data[order]
        most, real = _most(data), data.astype(np.float64)
        for block in blocks.select(("ids", "rows", "data")).to_batches(1):
            packed = block.to_pylist()[0]
            own, rows = np.frombuffer(packed["ids"], np.int64), np.frombuffer(packed["rows"], np.int64)
            asks = _matrix(packed["data"], len(own), data.shape[1])
            if most * _most(asks) * max(data.shape[1], 1) < 2**53:
                found = maxscore(asks.astype(np.float64), own, real, ids, k)
            else:
                found = large_scores(asks, own, data, ids, k)
            for number, places, scores in found:
                whole = np.array([min(max(int(s), _LEAST), _GREATEST) for s in scores], np.int64)
                row = (np.full(len(whole), own[number]), np.full(len(whole), rows[number]), ids[places], whole)
                for name, values in zip(_NAMES, row, strict=True):
                    columns[name].append(values)
    return pa.table({name: np.concatenate(parts) for name, parts in columns.items()})


def _each(count: int) -> Column:
    """One row for each number below the count."""
    if count == 1:
        return F.lit(0).cast("long")
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """The k highest inner products of each query with the other rows: query_id, rank, vec_id, score."""
    every = integer_vectors(vectors, id_column, vector_column, scale)
    every = every.withColumn("size", F.size("vector")).withColumn("row", F.monotonically_increasing_id())
    total, asked, widest = every.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max("size")).first()
    largest = max(SHARD_ROWS, GROUP_BYTES // (8 * (widest or 1)))
    shards = -(-total // min(largest, max(SHARD_ROWS, total // SHARDS))) or 1
    blocks, lanes = -(-asked // BLOCK_ROWS) or 1, -(-asked // largest) or 1
    spread = F.xxhash64("vec_id", "vector")
    candidates = every.select(
        F.pmod(spread, F.lit(shards)).alias("shard"), _each(lanes).alias("lane"), "size", "vec_id", "vector"
    )
    block = _pack(every.where(is_query).withColumn("block", F.pmod(spread, F.lit(blocks))), "block")
    # every block goes to every shard
    asked_of = block.select(
        _each(shards).alias("shard"), F.pmod("block", F.lit(lanes)).alias("lane"), "size", "ids", "rows", "data"
    )
    group = ("shard", "lane", "size")
    hits = candidates.groupBy(*group).cogroup(asked_of.groupBy(*group)).applyInArrow(
        lambda vectors, blocks: _search(vectors, blocks, k), _HITS
    )
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
