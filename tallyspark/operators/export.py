"""Transactions as delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import dims
from tallyspark.operators.classify import with_category


#: Folders of an export that is dealt by account; its columns.
PARTS = 64
COLUMNS = ["tanggal", "keterangan", "merchant", "kategori", "arah", "nominal", "saldo", "sumber", "keyakinan", "file"]


def export_columns(tx: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    """The ten columns of an export, all text, and more columns of tx."""
    label = F.lit(None).cast("string")
    for source, name in dims.SOURCE_LABELS.items():
        label = F.when(F.col("source") == source, name).otherwise(label)
    whole = lambda c: F.coalesce(F.round(c).cast("decimal(18,0)").cast("string"), F.lit(""))
    return with_category(tx).select(
        F.col("date").cast("string").alias("tanggal"), F.col("description").alias("keterangan"), F.coalesce("merchant", F.lit("")).alias("merchant"), F.col("label").alias("kategori"),
        F.when(F.col("direction") == "debit", "keluar").otherwise("masuk").alias("arah"), whole("amount").alias("nominal"), whole("balance").alias("saldo"), label.alias("sumber"),
        F.format_string("%.2f", F.col("confidence")).alias("keyakinan"), F.coalesce("file_name", F.lit("")).alias("file"), *more,
    )


def export_transactions(tx: DataFrame, path: str, by: list[str] | None = None, parts: int = PARTS) -> None:
    """Writes the export: every field quoted, quotes doubled, a header in each file.

    by: columns of tx that name a statement or an account; the rows of one then stand together, in the order of date and seq, in one
    text file of one of `parts` folders (part=...), dealt by hash: as many folders however many accounts there are. The write is
    committed as a whole: readers see the marker that Spark writes last, or none."""
    rows = export_columns(tx)
    if by:
        order = [c for c in ("date", "file_idx", "seq") if c in tx.columns]
        keys = [F.col(c).alias(f"_{c}") for c in [*by, *order]]
        part = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int").alias("part")
        rows = export_columns(tx, [part, *keys]).repartition("part").sortWithinPartitions("part", *[f"_{c}" for c in [*by, *order]]).drop(*[f"_{c}" for c in [*by, *order]])
    writer = rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    (writer.partitionBy("part") if by else writer).csv(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export read back: its ten columns, all text, empty fields as empty text."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    out = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path)
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS])
