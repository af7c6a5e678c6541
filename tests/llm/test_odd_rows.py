"""Rows that are repeated whole, repeated ids, and numbers beyond float64."""

import numpy as np
from pyspark.sql import functions as F

from bizpanel.llm import topk
from bizpanel.llm.linear import labelled_sample
from bizpanel.llm.sharding import shard_rows
from bizpanel.llm.topk import exact_top_k, large_scores, maxscore


def test_repeated_rows_are_divided_between_shards(spark):
    rows = [(None, "same text")] * 1600 + [(i, f"text number {i} of many") for i in range(1600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    placed = shard_rows(frame).collect()
    size = [0] * 16
    for r in placed:
        size[r["shard"]] += r["size"]
    assert sum(size) == sum(len(t) + 1 for _, t in rows)
    share = sum(size) / 16
    assert all(abs(s - share) < 0.05 * share for s in size)
    for shard in range(16):
        slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_each_row_of_a_query_has_its_ranking(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0])] + [(i, [float(i), -float(i)]) for i in range(1, 9)]
    found = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50)
    got = sorted(tuple(r) for r in found.select("rank", "vec_id", "score").collect())
    best = [(k, 9 - k, 256 * 256 * (9 - k)) for k in range(1, 6)]
    worst = [(k, k, -256 * 256 * k) for k in range(1, 6)]
    assert got == sorted(best + best + worst)


def test_large_components_are_exact(spark):
    rows = [(0, [4e7, 1.0]), (1, [4e7, 3.0]), (2, [4e7, 2.0]), (3, [-4e7, 0.0])]
    found = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    ask = 256 * 40_000_000
    expected = [(1, 1, ask * ask + 256 * 768), (2, 2, ask * ask + 256 * 512), (3, 3, -ask * ask)]
    assert [tuple(r) for r in found.select("rank", "vec_id", "score").orderBy("rank").collect()] == [
        (rank, vec, min(max(score, -(1 << 63)), (1 << 63) - 1)) for rank, vec, score in expected
    ]


def test_both_ways_agree():
    pick = np.random.default_rng(5)
    vectors, queries = pick.integers(-300, 300, (60, 7)), pick.integers(-300, 300, (9, 7))
    ids, own = np.arange(60), np.arange(9)
    plain = maxscore(queries.astype(float), own, vectors.astype(float), ids, 5)
    for (_, a, s), (_, b, t) in zip(plain, large_scores(queries, own, vectors, ids, 5)):
        assert a.tolist() == b.tolist() and s.tolist() == t


def test_the_sample_is_bounded_by_rows(spark):
    texts = [(1, f"hot {i}") for i in range(500)] + [(2, "two"), (3, None), (4, "four")]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] + [(1, 0)], "doc_id long, rating int")
    sample = labelled_sample(documents, ratings, "doc_id", "text", 10).collect()
    assert len(sample) == 3
    assert sum(r["text"].startswith("hot") for r in sample) == 1


def test_neighbours_over_many_shards_and_lanes(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 8), ("BLOCK_ROWS", 2), ("SHARDS", 4), ("GROUP_BYTES", 1)):
        monkeypatch.setattr(topk, name, value)
    pick = np.random.default_rng(7)
    rows = [(i % 70, pick.normal(0, 4, 3 if i % 9 else 5).round(2).tolist()) for i in range(90)] + [(3, []), (4, [])]
    found = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, 4)
    # the queries reach every shard by shuffle: Spark measures them before they are repeated
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    expected = []
    for own, q in ints:
        if own % 3 == 0:
            others = [(-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ints if i != own and len(v) == len(q)]
            expected += [(own, rank, i, -s) for rank, (s, i) in enumerate(sorted(others)[:4], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_packed_numbers_keep_their_value():
    for ends in ((-128, 127), (-129, 5), (0, 1 << 20), (-(1 << 63), (1 << 63) - 1)):
        numbers = np.array([*ends, 0, 1], np.int64)
        packed = topk._narrow(numbers).tobytes()
        assert topk._matrix(packed, 2, 2).ravel().tolist() == numbers.tolist()
    assert len(topk._narrow(np.array([300, -4], np.int64)).tobytes()) == 4
