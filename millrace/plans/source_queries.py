"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.plans.catalog import register, table
from millrace.plans.dedup_queries import PERMISSION_SQL
from millrace.session import scratch_path
from millrace.sources import blocks, jsonl


@register(
    "s7_bucket_scan",
    """WITH c AS (SELECT n AS counter, (('0x' || substr(sha256('millrace-bucket|src0|' || n), 1, 8))::UBIGINT % 256)::BIGINT AS slot FROM range(0, 8192) t(n)),
    f AS (SELECT slot, min(counter) AS counter FROM c GROUP BY slot), b AS (SELECT printf('%02x', slot) AS bucket FROM f QUALIFY row_number() OVER (ORDER BY counter) <= 64)
    SELECT doc_id, lang, source, n_chars FROM documents WHERE substr(sha256(doc_id::VARCHAR), 1, 2) IN (SELECT bucket FROM b)""",
)
def s7_bucket_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns of the chosen buckets of a table that lies in a folder a bucket: both reach the scan."""
    path = scratch_path(spark, "buckets")
    docs = table(spark, sf_dir, "documents").withColumn("hub_bucket", F.substring(ids.sha256(F.col("doc_id").cast("string")), 1, 2))
    docs.repartition("hub_bucket").write.partitionBy("hub_bucket").parquet(path)
    chosen = [r.bucket for r in blocks.bucket_ids(spark, "src0", 64).collect()]  # 256 at the most
    return blocks.bucket_scan(spark, path, chosen, ["doc_id", "lang", "source", "n_chars"])


@register("s8_s9_jsonl_round_trip", "SELECT item_id, text FROM benchmark")
def s8_s9_jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as gzip JSON lines to the shared folder and read back."""
    path = scratch_path(spark, "jsonl")
    jsonl.write_jsonl(table(spark, sf_dir, "benchmark"), path, ["item_id"])
    return jsonl.read_jsonl(spark, path, "item_id long, text string")


@register("s15_cached_pages", "SELECT item_id, text FROM benchmark")
def s15_cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of cached pages of ten, in the form that a paged service answers in."""
    path = scratch_path(spark, "pages")
    rows = table(spark, sf_dir, "benchmark")
    page = rows.groupBy(F.floor(F.col("item_id") / 10).alias("page")).agg(F.collect_list(F.struct(F.struct("item_id", "text").alias("row"))).alias("rows"))
    page.select("rows").write.option("compression", "gzip").json(path)
    return jsonl.cached_rows(spark, path, "item_id long, text string")


@register(
    "s16_snapshot_totals",
    f"SELECT {PERMISSION_SQL.format(id='doc_id')} AS permission, count(*)::BIGINT AS records, sum(length(text))::BIGINT AS characters FROM documents GROUP BY 1",
)
def s16_snapshot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(ids.permission(F.col("doc_id")).alias("permission")).agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"))


@register(
    "s17_index_upsert",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM documents",
)
def s17_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with every fifth entry replaced."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("version"))
    return jsonl.upsert(old, old.where("doc_id % 5 = 0").withColumn("version", F.lit("new")), "doc_id")


@register("s18_first_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 137")
def s18_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a stream, by its ordinal. The limit is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(137)


@register(
    "s19_proxy_questions",
    "SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN text END, ''), text) AS question FROM conversations WHERE coalesce(nullif(CASE WHEN role = 'user' THEN text END, ''), text) <> ''",
)
def s19_proxy_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several fields that holds text."""
    own = F.nullif(F.when(F.col("role") == "user", F.col("text")), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(own, "text").alias("question")).where("question <> ''")
