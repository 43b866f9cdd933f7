"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.shared import leave

#: White space as every operator here means it, and words between it (regular expressions).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one of our own serves if
    all run on one machine, as in tests; else executors would each write to their own disk, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}")
    return _own[0]


def stored(df: DataFrame, what: str = "part") -> DataFrame:
    """df written once as Parquet into the shared folder and read back: lineage ends there and a lost executor costs no recomputation.
    It is deleted when the program ends, or before by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Spark deletes the shuffle files of what was just run once the driver's garbage is collected, and not before
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jvm.System.gc()
    leave(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave and that nothing reads any more: all that was made of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lowered and nothing else. Text of ASCII alone goes through lower(), which gives the same there and is quicker."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes h1 and h2, together a 128-bit key for equality of whole strings."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(0x5DEECE66D), c).alias("h2")]
