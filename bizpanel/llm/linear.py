"""Sparse linear models that are fitted in one task on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.llm.scratch import small


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


class Incidence:
    """Which rows have which features; features are numbered 0, 1, ... by ``names``."""

    def __init__(self, packed: list[bytes], names: np.ndarray | None = None) -> None:
        flat = [np.frombuffer(p, "<u4").astype(np.int64) for p in packed]
        self.rows = len(flat)
        row = np.repeat(np.arange(self.rows), [len(f) for f in flat])
        feature = np.concatenate([np.zeros(0, np.int64), *flat])
        if names is None:
            self.names, column = np.unique(feature, return_inverse=True)
            self.row, self.column = row, column
        else:
            self.names = np.sort(names)
            place = np.searchsorted(self.names, feature)
            known = place < len(self.names)
            known[known] = self.names[place[known]] == feature[known]
            self.row, self.column = row[known], place[known]

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """The sum of the rows' weights for each feature."""
        return np.bincount(self.column, weight[self.row], len(self.names))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Each row's sum of the weights of its features."""
        return np.bincount(self.row, weights[self.column], self.rows)


def telling_features(
    x: Incidence, target: np.ndarray, most: int, least_rows: int = 5, least_score: float = 5.0
) -> np.ndarray:
    """Names of the features that tell rows of high from rows of low target best, by z-score."""
    every = x.counts(np.ones(x.rows))
    mean = target.mean()
    spread = np.sqrt(np.maximum(every * target.var(), 1e-12))
    score = np.abs(x.counts(target) - every * mean) / spread
    score[every < least_rows] = 0
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(x.names[best[score[best] > least_score]])


def descend(
    gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float
) -> np.ndarray:
    """Adam with a falling rate, from the start, for so many steps."""
    at, first, second = start.astype(float), np.zeros(len(start)), np.zeros(len(start))
    for k in range(1, steps + 1):
        g = gradient(at)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        step = first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        at = at - rate * (1 - 0.9 * k / steps) * step
    return at


def labelled_sample(
    documents: DataFrame, ratings: DataFrame, id_column: str, text_column: str, most: int
) -> DataFrame:
    """Texts and ratings of at most ``most`` rated ids, those of the smallest hashes: as many rows at most.

    ``ratings`` has the id and ``rating``; of several ratings of an id the smallest holds, and of several texts the
    one with the smallest hash.
    """
    rated = ratings.where(F.col(id_column).isNotNull() & F.col("rating").isNotNull())
    rated = rated.groupBy(id_column).agg(F.min("rating").alias("rating"))
    chosen = rated.orderBy(F.xxhash64(id_column), id_column).limit(most)
    rows = documents.select(id_column, F.col(text_column).alias("text"))
    found = rows.join(small(chosen, 24, most), id_column).where(F.col("text").isNotNull())
    one = found.groupBy(id_column, "rating").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("text", "rating")


def fit_in_one_task(
    sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], dict[str, bytes]]
) -> dict[str, bytes]:
    """Fits on a bounded sample (features, rating); the model comes back as named byte strings."""

    def run(table: pa.Table) -> pa.Table:
        rating = table.column("rating").to_numpy()
        order = np.argsort(rating, kind="stable")
        model = fit([table.column("features")[int(i)].as_py() for i in order], rating[order])
        return pa.table({"name": list(model), "data": pa.array(model.values(), pa.binary())})

    whole = sample.select("features", "rating").withColumn("all", F.lit(0)).groupBy("all")
    return {r["name"]: r["data"] for r in whole.applyInArrow(run, "name string, data binary").collect()}
