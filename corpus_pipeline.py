"""A corpus from raw documents to token digests: language ID, line dedup, near duplicates, decontamination, BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for the last, returns the
columns of documents. ``run`` writes what a stage returns as Parquet in the cluster's shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabverity.llm import bpe, decontaminate, jaccard, language, lines
from tabverity.llm.common import materialize, read_table
from tabverity.llm.queries import tokenizer_path

#: A document stays if one language has at least this share of the letters that any language claims.
LEAST_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those without a main language."""
    return language.keep_identified(docs, language.train(docs), least_score=LEAST_LANGUAGE_SHARE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines; all documents stay, ``n_chars`` follows the text."""
    cut = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents; repeated rows count once."""
    found = jaccard.near_duplicates(docs)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["stays"]), "left_semi").dropDuplicates(["doc_id", "text"])


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_and_decode(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_documents),
    ("BPE encoding and decoding", encode),
]

#: Trained language models and tokenizers can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
