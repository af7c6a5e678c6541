"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(s - t_k) with one score s for all grades and ordered thresholds t_1 < t_2 < ...
The score adds shared weights of a text's hashed features: its words and buckets of its shape. The
expected grade is the sum of the tail probabilities; rows are selected by one tail probability.

Fitted in one task on at most ``SAMPLE_ROWS`` rated rows, those of the smallest id hashes. All other rows
are scored where they lie.

Defined results: null and empty texts have the features of a text without words. Rows pass through with null
and repeated ids. Without ratings, or with one grade only, every row has the share of that grade as
its probability. Extra columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.llm.linear import (
    Incidence,
    descend,
    fit_in_one_task,
    labelled_sample,
    sigmoid,
    telling_features,
)
from bizpanel.llm.text_features import HASH_BITS, SHAPE, SPACE, extract
from bizpanel.llm.words import text_chunks

#: Most rated rows that the model is fitted on.
SAMPLE_ROWS = 12_000
#: Most hashed features with a weight.
FEATURES = 2_048
#: Penalties of shape and word weights: words only add to what the shape says.
_RIDGE, _WORD_RIDGE = 5e-4, 2e-2
_STEPS, _RATE = 400, 0.08


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of features and ordered thresholds."""

    names: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> np.ndarray:
        table = np.zeros(SPACE)
        table[self.names] = self.weights
        return table


def _thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers."""
    return raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))


def fit_ordinal(x: Incidence, grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood of the grades."""
    tail = np.array([np.clip((grade >= k).mean(), 0.01, 0.99) for k in range(1, grades)])
    start = -np.log(tail / (1 - tail))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    m = len(x.names)
    ridge = np.where(x.names >> HASH_BITS == SHAPE, _RIDGE, _WORD_RIDGE)

    def gradient(at: np.ndarray) -> np.ndarray:
        weights, raw = at[:m], at[m:]
        t = _thresholds(raw)
        score = x.times(weights)
        # P(grade = g) = upper - lower of neighbouring tails
        tails = np.concatenate(
            (np.ones((len(grade), 1)), sigmoid(score[:, None] - t), np.zeros((len(grade), 1))), axis=1
        )
        rows = np.arange(len(grade))
        high, low = tails[rows, grade], tails[rows, grade + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        by_score = -(d_high - d_low) / len(grade)
        by_t = np.zeros(grades - 1)
        for k in range(1, grades):
            by_t[k - 1] = (d_high[grade == k].sum() - d_low[grade == k - 1].sum()) / len(grade)
        by_raw = np.concatenate(([by_t.sum()], [by_t[j:].sum() * np.exp(raw[j]) for j in range(1, grades - 1)]))
        return np.concatenate((x.counts(by_score) + ridge * weights, by_raw))

    found = descend(gradient, np.concatenate((np.zeros(m), start[:1], gaps)), _STEPS, _RATE)
    return found[:m], _thresholds(found[m:])


def _fit(grades: int):
    def fit(packed: list[bytes], rating: np.ndarray) -> dict[str, bytes]:
        grade = rating.astype(np.int64)
        names = telling_features(Incidence(packed), grade.astype(float), FEATURES)
        x = Incidence(packed, names)
        weights, thresholds = fit_ordinal(x, grade, grades)
        return {"names": x.names.tobytes(), "weights": weights.tobytes(), "thresholds": thresholds.tobytes()}

    return fit


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches, "text"):
        packed = extract(chunk.column("text")).of_rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(packed, pa.binary()), chunk.column("rating")], names=["features", "rating"]
        )


def fit_quality(
    documents: DataFrame,
    ratings: DataFrame,
    grades: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> OrdinalModel:
    """The model of ratings (id, rating from 0 to grades - 1)."""
    sample = labelled_sample(documents, ratings, id_column, text_column, sample_rows)
    featured = sample.withColumn("rating", F.col("rating").cast("long")).mapInArrow(
        _featurise, "features binary, rating long"
    )
    model = fit_in_one_task(featured, _fit(grades))
    if not model:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(grades - 1))
    return OrdinalModel(
        np.frombuffer(model["names"], np.int64),
        np.frombuffer(model["weights"]),
        np.frombuffer(model["thresholds"]),
    )


def _scorer(model: OrdinalModel, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        wanted = table != 0
        for chunk in text_chunks(batches, "text"):
            found = extract(chunk.column("text"), wanted=wanted)
            score = np.bincount(found.row, table[found.feature], chunk.num_rows)
            tails = sigmoid(score[:, None] - model.thresholds)
            yield pa.RecordBatch.from_arrays(
                [
                    *(chunk.column(name) for name in passed),
                    pa.array(tails.sum(axis=1)),
                    pa.array(list(tails), pa.list_(pa.float64())),
                ],
                names=[*passed, "expected_grade", "tails"],
            )

    return run


def score_quality(
    documents: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Each row's id, text, expected grade, and tail probabilities P(grade >= 1), P(grade >= 2), ..."""
    rows = documents.select(id_column, F.col(text_column).alias("text"))
    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, text string, expected_grade double, tails array<double>"
    return rows.mapInArrow(_scorer(model, [id_column, "text"]), schema)


def _passing(model: OrdinalModel, grade: int, least: float):
    held: list[np.ndarray] = []

    def passes(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(model.table())
        table = held[0]
        wanted = table != 0
        out = [np.zeros(0, bool)]
        for chunk in text_chunks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text"):
            found = extract(chunk.column("text"), wanted=wanted)
            score = np.bincount(found.row, table[found.feature], chunk.num_rows)
            out.append(sigmoid(score - model.thresholds[grade - 1]) >= least)
        return pa.array(np.concatenate(out))

    return passes


def select_rows(
    documents: DataFrame, model: OrdinalModel, text_column: str = "text", grade: int = 1, least: float = 0.5
) -> DataFrame:
    """The rows, with all their columns, whose probability of at least this grade is high enough.

    Only the texts go to Python and only a flag per row comes back; the rows stay in Spark.
    """
    passes = F.arrow_udf(_passing(model, grade, least), "boolean")
    return documents.where(passes(F.col(text_column)))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for poor text, 1 for sound but toxic text, 2 for sound text."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(quality == 1, 2)


