"""A corpus pipeline over documents: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontamination, jaccard_groups, language_id, secret_scans, sentencepiece_arrays
from engram.llm.queries import vocabulary
from engram.llm.tables import documents, stage

#: Low for hardly any text: with two families of two languages all score 0.25 or more, so only 'und' is rejected.
MIN_LANGUAGE_SCORE = 0.2


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from those outside the held-out fold."""
    model = language_id.fit_language_model(docs.where(~language_id.held_out(F.col("doc_id"))), key=F.col("doc_id"))
    return language_id.keep_identified(docs, model, MIN_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: the one of the smallest id."""
    return jaccard_groups.keep_one_of_each(docs, jaccard_groups.Threshold(k=5, of=80))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scans.redact_secrets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_arrays.encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: The classifier and the suffix-array encoder have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
