"""Which blocks and buckets of a source are read: distinct slots, chosen by hashed counters, so the choice never changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.ids import hash_rank, unsigned


def _slots(spark: SparkSession, seed: str, source: str, digits: int, slots: int, count: int) -> DataFrame:
    if count > slots:
        raise ValueError("more blocks are asked for than there are")
    # few of many slots are drawn soon; if some repeat, the counters go on, at the most so far that only e ** -32 of all slots are left out
    draws, most = 2 * count + 64, 32 * slots + 160
    while True:
        draws = min(draws, most)
        h = F.substring(hash_rank(seed, F.lit(source), F.col("counter")), 1, digits)
        first = spark.range(draws).withColumnRenamed("id", "counter").groupBy((unsigned(h) % slots).cast("long").alias("slot")).agg(F.min("counter").alias("counter"))
        if draws == most or first.count() >= count:
            break
        draws *= 4
    return first.withColumn("place", F.row_number().over(Window.orderBy("counter")).cast("long")).where(F.col("place") <= count)


def block_offsets(spark: SparkSession, source: str, rows: int, blocks: int, block: int = 100) -> DataFrame:
    """(block_offset, place) of distinct blocks of `block` rows."""
    return _slots(spark, "millrace-block", source, 16, max(1, rows // block), blocks).select((F.col("slot") * block).alias("block_offset"), "place")


def bucket_ids(spark: SparkSession, source: str, count: int, buckets: int = 256) -> DataFrame:
    """(bucket, place) of distinct buckets, two hex digits each."""
    return _slots(spark, "millrace-bucket", source, 8, buckets, count).select(F.lpad(F.lower(F.hex("slot")), 2, "0").alias("bucket"), "place")


def bucket_scan(spark: SparkSession, path: str, buckets: list[str], columns: list[str]) -> DataFrame:
    """Columns of the chosen buckets of a table in Hive's layout (hub_bucket=xx): only their folders and those columns are read."""
    return spark.read.parquet(path).where(F.col("hub_bucket").cast("string").isin(buckets)).select(*columns)
