"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing and token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet to the shared folder
and read again as the next stage's docs. All stages but the last return the columns of documents, whatever they are (their own
columns begin with an underscore), and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, mixing, ngram_jaccard, quality_rules, token_output
from millrace.llm.shared import stored
from millrace.session import ship

#: SQL can't express the label model's expectation-maximisation or the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a null or empty text has no words and is rejected. Equal rows are judged alike."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows stays, the one of the smallest doc_id (null last), then of the smallest text hash. A row is a node
    whatever its doc_id, so a null or repeated one loses no text of its own; rows without words link with nothing and stay."""
    return ngram_jaccard.keep_texts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null and empty texts hold none; an empty benchmark removes nothing."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: never, once or twice. A null source is a source; null and empty texts are never taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the binary format, read back: doc_id, start, n_tokens, ids_crc32. Null doc_ids come first, rows of one doc_id stand beside
    each other, a null text is an empty one."""
    return token_output.report(docs)


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [(f.__name__, _shipped(f)) for f in (quality, near_duplicates, decontaminate, mix, tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; returns the last one's result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
