"""The registered queries of the operators, over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizpanel.llm import sql
from bizpanel.llm.bpe import encode_documents
from bizpanel.llm.collocations import mine_collocations
from bizpanel.llm.decontamination import decontaminate
from bizpanel.llm.jaccard_join import similar_components
from bizpanel.llm.license_scan import licence_labels, scan_licences
from bizpanel.llm.merkle import build_manifest, document_leaves
from bizpanel.llm.ngram_lm import fit_ngrams, not_learned, perplexity, score_texts
from bizpanel.llm.quality import fit_quality, grade_of, score_quality
from bizpanel.llm.sharding import LAW, shard_rows
from bizpanel.llm.substring_dedup import remove_repeats
from bizpanel.llm.token_counts import section_tokens
from bizpanel.llm.topk import exact_top_k
from bizpanel.llm.toxicity import fit_toxicity, held_out, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Grades of the labels: poor, sound but toxic, sound.
GRADES = 3


def graded(labels: DataFrame) -> DataFrame:
    """Labels as ratings."""
    return labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("rating"))


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each line of each document; a crossing token goes to the line with most of it."""
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return section_tokens(table(spark, folder, "documents"), rank_file, public_tokenizers.PATTERN)


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Base phrases, labels and spans of licence notices."""
    return licence_labels(scan_licences(table(spark, folder, "documents")))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade and tail probabilities of every document."""
    documents = table(spark, folder, "documents")
    model = fit_quality(documents, graded(table(spark, folder, "labels")), GRADES)
    tail = F.col("tails")[0]
    return score_quality(documents, model).select(
        "doc_id",
        "expected_grade",
        tail.alias("p_sound"),
        F.col("tails")[1].alias("p_best"),
        (tail >= 0.5).alias("selected"),
    )


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that a 13-word window of a smaller doc_id covers, and the rest's digest."""
    cleaned = remove_repeats(table(spark, folder, "documents"), digests=True)
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of toxicity of every document, learned without the held-out fifth."""
    documents = table(spark, folder, "documents")
    ratings = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("rating"))
    scored = score_toxicity(documents, fit_toxicity(documents, ratings))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_documents(table(spark, folder, "documents"), path, digests=True)


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose word 5-grams reach a Jaccard similarity of 0.75."""
    return similar_components(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that stand in a benchmark window."""
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated"
    )


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    placed = shard_rows(table(spark, folder, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Five best neighbours of every fiftieth vector."""
    return exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every text under a Kneser-Ney model of the documents that are not held out."""
    documents = table(spark, folder, "documents")
    model = fit_ngrams(documents.where(~not_learned(F.col("doc_id"))))
    return score_texts(documents, model).select(
        "doc_id",
        not_learned(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"),
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document in a tree per language and one over the languages; altered sizes are found."""
    manifest = build_manifest(document_leaves(table(spark, folder, "documents")))
    return manifest.drop("tree").withColumnRenamed("id", "doc_id")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of each language that stand together most tellingly."""
    return mine_collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_license_scan,
        op3_quality,
        op4_substring_dedup,
        op5_toxicity,
        op6_bpe,
        op7_jaccard_join,
        op8_decontamination,
        op9_sharding,
        op10_topk,
        op11_lm_scoring,
        op12_merkle_manifest,
        op13_collocations,
    )
}
ORACLES: dict[str, str] = sql.ORACLES
