"""Toxicity by weak supervision.

Voters look for lexicons (written down below, or drawn from rated rows, one for whole words and one for
each length of first bytes) and for shape patterns. A generative label model estimates by EM how often
each voter fires on toxic and on other texts, without looking at ratings again, and from the voters'
correlations given the label how much of its evidence is its own. A linear classifier on hashed
features is then trained on the model's posterior labels; it scores all texts.

Fitted in one task on at most ``SAMPLE_ROWS`` rated rows, those of the smallest id hashes, and only on rows for
which crc32(id as text) mod 5 is not 0. Only texts are inputs of a score.

Defined results: null and empty texts are scored as texts without words. Rows pass through with null and repeated
ids; a null id is not held out. Without ratings every score is 0. Extra columns are dropped. An empty table
gives an empty table.
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
from bizpanel.llm.text_features import (
    HASH_BITS,
    PREFIX,
    PREFIX_BYTES,
    SHAPE,
    SPACE,
    WORD,
    extract,
    word_feature,
)
from bizpanel.llm.words import text_chunks

#: Most rated rows that voters, label model and classifier are fitted on.
SAMPLE_ROWS = 12_000
#: Most hashed features with a weight.
FEATURES = 4_096
#: Words of the written lexicons, by what they insult.
LEXICONS = {
    "mind": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "fools"),
    "worth": ("worthless", "loser", "losers", "scum", "trash", "garbage", "vermin", "filth"),
    "disgust": ("disgusting", "pathetic", "vile", "repulsive", "gross"),
    "ridicule": ("clown", "clowns", "freak", "joke", "laughable"),
}
_EM_ROUNDS, _STEPS, _RATE, _RIDGE = 50, 400, 0.08, 4e-4


@dataclass(frozen=True)
class LabelModel:
    """How often each voter fires on toxic and on other texts, and how much of its evidence is its own."""

    prior: float
    fires_on_toxic: np.ndarray
    fires_on_others: np.ndarray
    own: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.fires_on_toxic, self.fires_on_others
        fired, silent = np.log(a / b), np.log((1 - a) / (1 - b))
        evidence = (np.where(votes, fired, silent) * self.own).sum(axis=1)
        return sigmoid(np.log(self.prior / (1 - self.prior)) + evidence)


def fit_label_model(votes: np.ndarray, start: np.ndarray) -> LabelModel:
    """EM from a first guess of the labels; correlated voters share their evidence."""
    label, m = np.clip(start, 0.02, 0.98), votes.shape[1]
    model = None
    for k in range(_EM_ROUNDS):
        toxic, other = label.sum(), (1 - label).sum()
        a = np.clip((label @ votes + 0.5) / (toxic + 1), 1e-3, 1 - 1e-3)
        b = np.clip(((1 - label) @ votes + 0.5) / (other + 1), 1e-3, 1 - 1e-3)
        prior = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
        # what voters have in common beyond the label
        mean = label[:, None] * a + (1 - label[:, None]) * b
        left = votes - mean
        spread = np.sqrt(np.maximum((left * left).mean(axis=0), 1e-9))
        correlation = np.clip((left.T @ left) / len(votes) / np.outer(spread, spread), 0, 1)
        model = LabelModel(prior, a, b, 1 / np.maximum(correlation.sum(axis=0), 1))
        fresh = model.posterior(votes)
        if np.abs(fresh - label).max() < 1e-4 and k:
            break
        label = fresh
    return model


def _voters(x: Incidence, toxic: np.ndarray) -> list[np.ndarray]:
    """The features at which each voter fires."""
    voters = [np.array([word_feature(w) for w in words]) for words in LEXICONS.values()]
    every, hit = x.counts(np.ones(x.rows)), x.counts(toxic)
    # features that stand almost only in toxic rows, and in several of them
    sure = (hit >= 5) & (hit >= 0.8 * every)
    group = x.names >> HASH_BITS
    for g in (SHAPE, WORD, *(PREFIX + k for k in range(len(PREFIX_BYTES)))):
        voters.append(x.names[sure & (group == g)])
    return [v for v in voters if len(v)]


def fit_classifier(x: Incidence, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels."""

    def gradient(at: np.ndarray) -> np.ndarray:
        off = (sigmoid(x.times(at[:-1]) + at[-1]) - label) / len(label)
        return np.concatenate((x.counts(off) + _RIDGE * at[:-1], [off.sum()]))

    mean = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    start = np.zeros(len(x.names) + 1)
    start[-1] = np.log(mean / (1 - mean))
    found = descend(gradient, start, _STEPS, _RATE)
    return found[:-1], float(found[-1])


def _fit(packed: list[bytes], rating: np.ndarray) -> dict[str, bytes]:
    toxic = rating.astype(float)
    every = Incidence(packed)
    votes = []
    for features in _voters(every, toxic):
        named = np.isin(every.names, features)
        votes.append(every.times(named.astype(float)) > 0)
    if not votes or toxic.min() == toxic.max():
        label = toxic
    else:
        votes = np.stack(votes, axis=1).astype(float)
        label = fit_label_model(votes, toxic).posterior(votes)
    x = Incidence(packed, telling_features(every, label, FEATURES))
    weights, intercept = fit_classifier(x, label)
    return {"names": x.names.tobytes(), "weights": weights.tobytes(), "intercept": np.float64(intercept).tobytes()}


@dataclass(frozen=True)
class ToxicityModel:
    names: np.ndarray
    weights: np.ndarray
    intercept: float


def held_out(id_column: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches, "text"):
        packed = extract(chunk.column("text"), PREFIX_BYTES).of_rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(packed, pa.binary()), chunk.column("rating")], names=["features", "rating"]
        )


def fit_toxicity(
    documents: DataFrame,
    ratings: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """The model of ratings (id, rating 0 or 1) that are not held out."""
    open_rows = ratings.where(~held_out(F.col(id_column)))
    sample = labelled_sample(documents, open_rows, id_column, text_column, sample_rows)
    featured = sample.withColumn("rating", F.col("rating").cast("long")).mapInArrow(
        _featurise, "features binary, rating long"
    )
    model = fit_in_one_task(featured, _fit)
    if not model:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -40.0)
    return ToxicityModel(
        np.frombuffer(model["names"], np.int64),
        np.frombuffer(model["weights"]),
        float(np.frombuffer(model["intercept"])[0]),
    )


def _scorer(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SPACE)
        table[model.names] = model.weights
        wanted = table != 0
        for chunk in text_chunks(batches, "text"):
            found = extract(chunk.column("text"), PREFIX_BYTES, wanted)
            score = np.bincount(found.row, table[found.feature], chunk.num_rows) + model.intercept
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(sigmoid(score))], names=["id", "score"]
            )

    return run


def score_toxicity(
    documents: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Each row's probability of being toxic."""
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    return rows.mapInArrow(_scorer(model), "id long, score double").withColumnRenamed("id", id_column)
