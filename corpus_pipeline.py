"""The corpus pipeline: stages over documents, each an operator of tallyspark.llm.

Each stage works on what its predecessor kept and returns the columns of documents, but for the last, which returns packed
pieces. Every stage handles nulls, empty texts, repeated rows, empty tables and extra columns as its operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, minhash, mixing, packing, quality
from tallyspark.llm.common import stored, table


def apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs, whatever their names: those that documents do not have go by a number meanwhile, so
    that none of them meets a name that an operator gives."""
    own = {"doc_id", "text", "lang", "source", "n_chars"}
    names = {c: f"more{i}" for i, c in enumerate(docs.columns) if c not in own}
    out = stage(docs.withColumnsRenamed(names))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on the labelled ones among them, accepts."""
    return apart(docs, lambda d: quality.rejected_removed(d, table(spark, sf_dir, "labels")))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them hold; n_chars follows the text."""

    def stage(docs: DataFrame) -> DataFrame:
        out, changed = line_dedup.line_dedup(docs), F.col("_n_dropped") > 0
        out = out.withColumn("text", F.when(changed, F.col("_kept")).otherwise(F.col("text")))
        return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out

    return apart(docs, stage)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near-duplicates (0.8 of five-word shingles shared)."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id").distinct()
    return apart(docs, lambda d: d.join(gone, "doc_id", "left_anti"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return apart(docs, lambda d: mixing.mix(d).filter(F.col("_copies") > 0).withColumn("_copy", copies))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold all documents."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality", quality_filter), ("lines", line_filter), ("near_duplicates", near_duplicate_filter), ("mixing", source_mix), ("packing", packed)]
#: SQL has neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
