"""Intermediate tables that several later steps read."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; it goes when the program ends. Where that is
    unset, a temporary folder serves if all run on one machine, and nothing else does: executors elsewhere would each write to
    their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    leave(spark, path)
    return path


def leave(spark: SparkSession, path: str) -> None:
    """Has what is at a path deleted when the program ends: what a query gives out may be read until then."""
    if getattr(spark, "_jvm", None) is not None:
        _left.append((spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()))


@atexit.register
def clear() -> None:
    """Deletes all that was left. Tables that were read from there are gone."""
    while _left:
        path, conf = _left.pop()
        with contextlib.suppress(Exception):  # the store, or the JVM, may be gone before
            path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in a shared folder, read back: computed once, and safe against the loss of executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
