"""Queries of the training-data operators, pN_..., over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragstone.llm import leakage, mixing, multi_index, near_duplicates, quality, repeated_lines, splitting, truncation
from ragstone.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.similar_pairs(read_table(spark, sf_dir, "naive_rag"))


def p1_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.similar_vectors(read_table(spark, sf_dir, "naive_rag"))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.recall_report(read_table(spark, sf_dir, "naive_rag"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose_rows(read_table(spark, sf_dir, "ram_rag"), read_table(spark, sf_dir, "common_words"))


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "ram_rag"), read_table(spark, sf_dir, "common_words"))


def p2_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_by_source(read_table(spark, sf_dir, "ram_rag"), read_table(spark, sf_dir, "common_words"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_exact_lines(read_table(spark, sf_dir, "naive_rag"))


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(read_table(spark, sf_dir, "naive_rag"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_line_report(read_table(spark, sf_dir, "naive_rag"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(read_table(spark, sf_dir, "naive_rag"), min_similarity=0.75)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(read_table(spark, sf_dir, "naive_rag"), min_similarity=0.75)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_rows(read_table(spark, sf_dir, "chunk_lab"), read_table(spark, sf_dir, "strategy_limits"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(read_table(spark, sf_dir, "chunk_lab"), read_table(spark, sf_dir, "strategy_limits"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_report(read_table(spark, sf_dir, "chunk_lab"), read_table(spark, sf_dir, "strategy_limits"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_pairs"))


def p6_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leakage_by_item(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_pairs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.unreachable_sources(*(read_table(spark, sf_dir, t) for t in ("documents", "mix_targets", "common_words")))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_records(*(read_table(spark, sf_dir, t) for t in ("documents", "mix_targets", "common_words")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(*(read_table(spark, sf_dir, t) for t in ("documents", "mix_targets", "common_words")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_rows(read_table(spark, sf_dir, "documents"))


def p8_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_by_source(read_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit()}


def llm_sql() -> dict[str, str]:
    from ragstone.llm.sql import SQL

    return dict(SQL)
