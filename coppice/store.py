"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame


def _drop(spark, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone before Python ends
        pass


def store(df: DataFrame, name: str, kind: str = "parquet") -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` (a local folder only where that is
    unset and all of Spark is on this machine, as in tests) and read it back; removed
    by ``discard``, or when Python ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/coppice-{uuid.uuid4().hex}"
    df.write.format(kind).save(f"{path}/{name}")
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).format(kind).load(f"{path}/{name}")
    out._stored = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``store`` wrote; others stay."""
    if path := getattr(df, "_stored", None):
        _drop(df.sparkSession, path)
