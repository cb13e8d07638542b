"""A training-data pipeline over ``documents``: language, exact copies, near copies, benchmark passages, tokens.

Stages that hand whole texts to Python workers write their result themselves, in small batches (``stage``); ``run`` writes
that of the others, so every result is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from quire.llm.common import read, stage
from quire.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letters); profiles come from all labelled documents."""
    return stage(language_id.keep_known(docs, language_id.learn(docs)), "known")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group (5-word shingles, similarity of 0.8 or more) the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget."""
    return stage(decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark")), "clean")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return stage(bpe.digests(docs, vocabulary()), "tokens")


STAGES = [("language_id", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_leaks), ("bpe", tokens)]

#: No stage but the second can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
