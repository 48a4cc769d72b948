"""Shared-storage helpers: staged tables that survive the loss of an executor.

A staged table is written as parquet under the folder the cluster names in
``spark.checkpoint.dir`` and read back, which cuts the lineage without keeping
blocks on any executor.  Only where that setting is absent (a local test) is a
folder of our own used, and only with a local master.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share; raises on a cluster that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass  # the session has ended; the folder belongs to the cluster's cleanup


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and return a DataFrame reading it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more, such as that of a loop's last round."""
    path = getattr(df, "_staged", None)
    if path:
        _remove(df.sparkSession, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in shared storage, removed at the end."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def small(df: DataFrame, max_rows: int) -> list | None:
    """Rows of ``df`` if there are at most ``max_rows``, else None (nothing unbounded is fetched)."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
