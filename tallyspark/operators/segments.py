"""Order-dependent steps over files of any length: a file's rows are cut into segments, and what a segment needs of those before it
is one row a segment.

A window over a whole file is one task, however long the file. Here a window is over a segment; the row before a segment's first
one, or a sum over all segments before it, comes from a table of one row a segment. Where the cuts lie changes no result. Files of
at most ROWS rows are one segment and need no such table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows of a segment, about; bytes of a table of cuts that is broadcast.
ROWS, SMALL = 1 << 20, 32 << 20


class Segments:
    """How the files of a table (one for each combination of keys) are cut along a column that orders their rows.

    The rows of each file are counted, and of files that are longer than ROWS the quantiles of the order taken; both are sums that
    are shuffled as one row a file and task. The cuts hold for every table with the same files and order: rows may be gone or changed."""

    def __init__(self, df: DataFrame, keys: list[str], order: str = "seq", rows: int | None = None):
        rows = rows or ROWS
        self.keys, self.order, self.cuts = keys, order, None
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        most, long = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count_if(F.col("_n") > rows)).first()
        if most > rows:
            parts = math.ceil(most / rows)
            own = df.select(*keys, order).join(sizes.filter(F.col("_n") > rows), keys, "left_semi")
            self.cuts = own.groupBy(*keys).agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts).alias("_cuts"))
            self.cuts = F.broadcast(self.cuts) if long * parts * 8 <= SMALL else self.cuts

    def cut(self, df: DataFrame) -> DataFrame:
        """df with _segment, its number within the file from 0."""
        if self.cuts is None:
            return df.withColumn("_segment", F.lit(0))
        at = F.size(F.filter("_cuts", lambda c: c <= F.col(self.order)))
        return df.join(self.cuts, self.keys, "left").withColumn("_segment", F.when(F.col("_cuts").isNull(), 0).otherwise(at)).drop("_cuts")

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_segment").orderBy(self.order)

    def _earlier(self, df: DataFrame, name: str, of: Column, over) -> DataFrame:
        """df with a column of its segment: over(of, window over the file's segments before it), where `of` sums up a segment."""
        w = Window.partitionBy(*self.keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
        own = df.join(self.cuts.select(*self.keys), self.keys, "left_semi").groupBy(*self.keys, "_segment").agg(of.alias("_of"))
        return df.join(own.select(*self.keys, "_segment", over(F.col("_of"), w).alias(name)), [*self.keys, "_segment"], "left")

    def before(self, df: DataFrame, name: str, fields: list[str]) -> DataFrame:
        """df(_segment) with a struct of the fields of the row right before in its file; null for the first."""
        df = df.withColumn(name, F.lag(F.struct(*fields)).over(self.window()))
        if self.cuts is None:
            return df
        ends = F.max_by(F.struct(*fields), self.order)
        df = self._earlier(df, "_ends", ends, lambda c, w: F.last(c).over(w))
        return df.withColumn(name, F.coalesce(name, "_ends")).drop("_ends")

    def last(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """df(_segment) with the largest value so far in its file, its own row included; nulls count for nothing."""
        df = df.withColumn(name, F.max(value).over(self.window()))
        if self.cuts is None:
            return df
        df = self._earlier(df, "_so_far", F.max(value), lambda c, w: F.max(c).over(w))
        return df.withColumn(name, F.greatest(name, "_so_far")).drop("_so_far")

    def place(self, df: DataFrame, name: str) -> DataFrame:
        """df(_segment) with the number of rows before it in its file."""
        df = df.withColumn(name, F.row_number().over(self.window()) - 1)
        if self.cuts is None:
            return df
        df = self._earlier(df, "_rows", F.count("*"), lambda c, w: F.sum(c).over(w))
        return df.withColumn(name, F.col(name) + F.coalesce("_rows", F.lit(0))).drop("_rows")
