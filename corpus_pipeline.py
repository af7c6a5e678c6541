"""A training-data pipeline: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), reads the tables beside documents from ``sf_dir``, and works on all that its
predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizpanel.llm.bpe import encode_documents
from bizpanel.llm.decontamination import decontaminate
from bizpanel.llm.jaccard_join import similar_components
from bizpanel.llm.quality import fit_quality, select_rows
from bizpanel.llm.queries import GRADES, graded, table
from bizpanel.llm.scratch import small, store
from bizpanel.llm.substring_dedup import remove_repeats


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of being sound text is below one half."""
    model = fit_quality(docs, graded(table(spark, sf_dir, "labels")), GRADES)
    return select_rows(docs, model)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar rows the one with the smallest id, and of its rows that with the smallest hash.

    Each row is a node of its own, so that rows that share an id are in one group only where their texts are
    similar. Rows without words or without id are in no group and stay.
    """
    node = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    numbered = store(docs.withColumn("row_node", node))
    found = similar_components(numbered, "row_node").where(F.col("row_node").isNotNull() & (F.col("n_shingles") > 0))
    order = numbered.select("row_node", F.struct("doc_id", F.xxhash64("text"), "row_node").alias("place"))
    grouped = store(found.join(order, "row_node").select("row_node", "component_id", "place"))
    kept = grouped.groupBy("component_id").agg(F.min("place").alias("place")).select("place.row_node")
    dropped = store(grouped.select("row_node").join(kept, "row_node", "left_anti"))
    return numbered.join(small(dropped, 16), "row_node", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a smaller id holds; a document of which nothing is left goes."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cleaned = remove_repeats(docs, carry=others)
    left = cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.col("kept_text")
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars"))}
    return left.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    found = decontaminate(docs.withColumn("key", key), table(spark, sf_dir, "benchmark"), "key")
    bad = found.where("contaminated").select("key").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("b.key.doc_id")) & (
        F.xxhash64("d.text") == F.col("b.key.text_hash")
    )
    return docs.alias("d").join(bad.alias("b"), same, "left_anti").select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    coded = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_sound),
    ("near_copies", keep_one_of_similar),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("tokens", to_tokens),
]

#: Training a classifier and merging tokens are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
