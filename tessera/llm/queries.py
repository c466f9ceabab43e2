"""Registered queries of the corpus operators, each over its whole table, and
DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, prefix_trie, quality, token_rollup, topk
from .common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_ts import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_rollup import rollup_report

    return rollup_report(table(spark, sf_dir, "documents"))


def token_counts_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's rollup with the versions that SQL can count."""
    from .token_rollup import pattern_report

    return pattern_report(table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_main import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search_report

    return search_report(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_columns,
        op2_secret_scan,
        op3_language_id,
        op4_line_dedup,
        op5_source_mixing,
        op6_minhash_near_dedup,
        op7_quality_cascade,
        op8_token_counts,
        token_counts_by_pattern,
        op9_html_main_text,
        op10_best_fit_packing,
        op11_exact_topk,
        op12_filter_audit,
        op13_conversation_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_quality_cascade": quality.SQL,
    "token_counts_by_pattern": token_rollup.SQL,
    "op11_exact_topk": topk.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_conversation_trie": prefix_trie.SQL,
}
