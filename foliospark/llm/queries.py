"""Named queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import batch_dedup, clusters, leaks, names, near_duplicates, nearest, subjects, tokenizer
from foliospark.session import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one person or organisation."""
    return names.spelling_pairs(_table(spark, sf_dir, "paper_metadata"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of paper_metadata that bring nothing new, with their paper's first row."""
    return batch_dedup.find_repeats(_table(spark, sf_dir, "paper_metadata"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of topics with the smallest row of their cluster."""
    return clusters.found_rows(_table(spark, sf_dir, "topics"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of topics with their sizes and most typical rows."""
    return clusters.describe_clusters(_table(spark, sf_dir, "topics"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the 5 most similar of the other."""
    return nearest.neighbour_pairs(_table(spark, sf_dir, "paper_embeddings_index"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of papers with nearly the same title and summary."""
    return near_duplicates.find_similar_papers(_table(spark, sf_dir, "paper_metadata"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper with its class of nearly equal ones, its links and best alignment."""
    return near_duplicates.classes_of_papers(_table(spark, sf_dir, "paper_metadata"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokenizer.encode_documents(_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the passage of an evaluation item."""
    return leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of each document."""
    return subjects.find_subjects(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "subject_labels"), _table(spark, sf_dir, "subjects"))


def queries() -> dict[str, Query]:
    found = (p1_found, p2_found, p3_found, p3_clusters, p4_found, p6_found, p6_classes, p7_ids, p8_found, p9_found)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
