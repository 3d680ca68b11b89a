"""From sources' rows to records: text, upstream id, and the gate on licenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ids import sha256
from millrace.functions.text import strip


def reasoning(question: Column, answer: Column) -> list[Column]:
    """text and upstream_id of a question with its worked answer: the id is the question's hash."""
    q, a = (strip(F.coalesce(c, F.lit(""))) for c in (question, answer))
    return [F.concat(F.lit("<question>\n"), q, F.lit("\n<reasoning>\n"), a).alias("text"), sha256(q).alias("upstream_id")]


def plain(text: Column, upstream: Column) -> list[Column]:
    """text and upstream_id as they are; null is empty."""
    return [F.coalesce(text, F.lit("")).alias("text"), F.coalesce(upstream.cast("string"), F.lit("")).alias("upstream_id")]


def license_gate(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose license is on the list, whatever its case; rows without one go."""
    return df.where(F.lower(column).isin(sorted({x.lower() for x in allowed})))
