"""Scratch tables, document groups and the exchange of hashed keys that the operators share.

Documents are dealt into groups of a few MB by a hash of doc_id. A group sends each distinct key it holds once to the
key's bucket, and the bucket answers the group. So one very common key costs one entry a group and not one a row, no
task's memory grows with the corpus, and the shuffle of the texts is made once and reused by every pass.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_path

GROUP_BYTES = 4 << 20
LOW_BITS = 40
U64 = np.uint64


def stored_at(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and its path: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    return stored_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0


def group_count(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """How many groups keep them at about group_bytes of text; it grows with the input."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, math.ceil(text_bytes(docs) / group_bytes))


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """(g, doc_id, text), g by a hash of doc_id; rows without a doc_id are spread by their text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    g = F.pmod(F.xxhash64(F.coalesce(doc_id, F.xxhash64(text))), F.lit(groups)).cast("int")
    return docs.select(g.alias("g"), doc_id.alias("doc_id"), text.alias("text"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, by its upper half."""
    return ((keys >> U64(32)) * U64(buckets)) >> U64(32)


def pack(values: np.ndarray, width: int = 5) -> bytes:
    """Ascending integers as byte planes, the most significant first; sorted values make the first planes compress well."""
    raw = np.ascontiguousarray(values, dtype=">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, 8 - width :].T).tobytes()


def unpack(raw: bytes, width: int = 5) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - width :] = planes.T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def slices(sorted_buckets: np.ndarray):
    """(bucket, from, to) of each run."""
    if len(sorted_buckets):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(sorted_buckets)) + 1, [len(sorted_buckets)]])
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(sorted_buckets[i]), i, j


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each run of equal values, and the runs' lengths."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
    return first, np.diff(np.concatenate([first, [len(sorted_values)]]))


def release() -> None:
    """At a task's end, gives freed memory back to the system: Python workers are reused and would hold it through the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        return


def columns(schema: pa.Schema, **values) -> pa.Table:
    return pa.table([pa.array(values[f.name], f.type) for f in schema], schema=schema)


MESSAGE = "b int, g int, p binary, q binary"
MESSAGE_SCHEMA = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("p", pa.binary()), ("q", pa.binary())])
REPLY = "g int, b int, p binary, q binary"
REPLY_SCHEMA = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("p", pa.binary()), ("q", pa.binary())])
