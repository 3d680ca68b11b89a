"""Sessions: settings the engine expects, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Arrow batches between the JVM and Python workers; Spark's own bound of 64 MB is held several times over in every task.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def session(master: str | None = None, app: str = "millrace") -> SparkSession:
    """A session with adaptive plans, UTC and Arrow; settings that the cluster gives stand."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the executors' Python workers, once an application, and bounds the session's Arrow batches unless it
    has a bound of its own."""
    context = spark.sparkContext
    name, bound = BATCH_BYTES
    if name not in spark.conf.getAll:
        spark.conf.set(name, bound)
    if context.applicationId in _shipped:
        return spark
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parent
    if top.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(top.rglob("*.py")):
                z.write(file, str(file.relative_to(top.parent)))
        context.addPyFile(path)
    return spark


_own: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is this machine."""
    global _own
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def stored(df, name: str = "t"):
    """df written to the shared folder and read back: computed once, and a cut in the lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
