"""The registered queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, mixing
from millrace.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.substring_dedup import digest, substring_dedup

    return digest(substring_dedup(_table(spark, sf_dir, "documents")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ngram_jaccard import ngram_jaccard

    return ngram_jaccard(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix_sources

    rows = mix_sources(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.selectExpr("doc_id", "_size AS size", "_source_size AS source_size", "_target AS target", "_taken AS taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontamination import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.url_filter import report

    return report(_table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.license_scan import report

    return report(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality_rules import report

    return report(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lm_scoring import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.token_output import report

    return report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_ngram_jaccard, op3_toxicity, op4_mixing, op5_decontamination, op6_url_filter, op7_license_scan, op8_quality_rules, op9_lm_scoring, op10_token_output)
}
ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.ORACLE, "op5_decontamination": decontamination.ORACLE}
