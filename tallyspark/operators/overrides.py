"""Corrections by hand that last: a table of overrides in versions.

A version is a folder of its own that holds all overrides. It counts once Spark has written its marker of success, so a reader sees
the whole of one version or of the one before, and a run that dies leaves the last good one in place. Two runs that write the same
version do not mix: the second one fails and may be made again, on what the first one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Overrides:
    """Overrides (keys, dedup_key, category, updated_at) under a path of any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], types: str = "account_id long"):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = f"{types}, dedup_key string, category string, updated_at long, version int"

    def _store(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def versions(self, whole: bool = True) -> list[int]:
        """The numbers of all whole versions, in order; or of those that were begun, too."""
        files, root = self._store()
        if not files.exists(root):
            return []
        made = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in files.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in found if not whole or files.exists(made(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        """The overrides of a version, by default the last; none before the first."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version or known[-1]}")

    def update(self, corrections: DataFrame) -> int:
        """Adds corrections(keys, dedup_key, category, updated_at) and returns the new version. For one dedup key the latest
        updated_at wins, of equal ones that of the later run."""
        new = max(self.versions(whole=False), default=0) + 1
        both = self.read().unionByName(corrections.select(*self.keys, "dedup_key", "category", F.col("updated_at").cast("long").alias("updated_at"), F.lit(new).alias("version")))
        last = F.max_by(F.struct("category", "updated_at", "version"), F.struct("updated_at", "version")).alias("_o")
        both.groupBy(*self.keys, "dedup_key").agg(last).select(*self.keys, "dedup_key", "_o.*").write.parquet(f"{self.path}/v{new}")
        return new

    def prune(self, keep: int = 2) -> None:
        """Deletes all whole versions but the last `keep`."""
        files, root = self._store()
        for v in self.versions()[: -max(1, keep)]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, f"v{v}"), True)
