"""Queries of the text operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontaminate, jaccard, language, lines, negatives, neighbours, pii, quality, simhash, substring, tokenfiles
from .common import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs.where(language.fold("doc_id", 4) != 2))
    held_out = (language.fold("doc_id", 4) == 2).alias("held_out")
    return language.identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "spans")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(language.fold("doc_id", 5) != 0))
    held_out = (language.fold("doc_id", 5) == 0).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_ids(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return tokenfiles.ids_digest(tokenfiles.read_ids(files, tokenfiles.write_manifest(files)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats_digest(substring.remove_repeats(read_table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_digest(pii.find_personal_data(read_table(spark, sf_dir, "documents")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=label)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_sources(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_line_dedup": op2_line_dedup,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_bpe": op5_bpe, "op6_token_output": op6_token_output, "op7_decontamination": op7_decontamination, "op8_substring_dedup": op8_substring_dedup,
        "op9_pii": op9_pii,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_simhash": op12_simhash,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": lines.dedup_sql(), "op7_decontamination": decontaminate.contamination_sql(), "op8_substring_dedup": substring.repeats_sql(),
        "op10_ngram_jaccard": jaccard.near_duplicates_sql(),
        "op11_hard_negatives": negatives.hard_negatives_sql(),
        "op13_source_divergence": audit.audit_sql(),
    }
