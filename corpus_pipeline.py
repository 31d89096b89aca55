"""A corpus pipeline: each stage takes the documents that the one before kept and decides about them.

Rows without a doc_id pass the stages that tell rows apart by it. Every stage but the last returns the columns of
documents; n_chars is kept in step with text where a stage changes it. run() applies the stages one to the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, ngram_join, queries, substring_dedup, toxicity, unigram
from parlance.llm._cluster import Scratch

#: No SQL has these results: stages 1 and 5 are a trained model and a Viterbi search. The tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.3 or more."""
    return toxicity.keep_civil(docs, _table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each component of documents whose 5-word shingles have similarity 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, num=80, den=100)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines and passages out of text that occurred before; the document stays."""
    return substring_dedup.keep_rest(docs, substring_dedup.LEAST_WORDS, every_line=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold 10 consecutive words of a benchmark item."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"), window=10)


def tokenizing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece pieces of what is left, checked by decoding."""
    return unigram.encode(docs.select("doc_id", "text"), queries.vocabulary("piece_bpe_32k.model")).select("doc_id", "n_pieces", "piece_ids", "decodes")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", tokenizing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next one reads it."""
    scratch = Scratch(spark, "corpus_pipeline")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
