"""Statement files from text to merged, classified transactions, as one job for any number of accounts and files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import classify, ledger, merge
from tallyspark.operators.segments import Segments
from tallyspark.sources import shared, statements


class Statements(NamedTuple):
    """files: one row a file (bank, label, rows, needs_ai, period); rows: transactions of all files; merged: without those that an
    earlier file of the account has; summary: one row an account; warnings: everything that reading and merging did."""

    files: DataFrame
    rows: DataFrame
    merged: DataFrame
    summary: DataFrame
    warnings: DataFrame


def read_and_merge(lines: DataFrame, keys: list[str], default_year: int = 2026, zeros: bool = False) -> Statements:
    """lines(keys, file_idx, file_name, line_no, text) of text files of any kind, as read_statement_text and the caller's own columns
    give them: keys name an account, file_idx the order of its files. zeros: rows with an amount of zero are transactions too.

    Records, and rows after each step that several tables come from, are written once."""
    file_keys = [*keys, "file_idx"]
    lines = shared.written(lines.select(*file_keys, "file_name", "line_no", "text"), "lines")
    names = lines.groupBy(*file_keys).agg(F.min("file_name").alias("file_name"))
    told = shared.written(statements.statement_files(lines, file_keys, delimiters=True), "files")
    records = shared.written(statements.read_records(lines, file_keys, default_year, zeros, told), "records")
    kept = records.filter(~F.col("skipped")).drop("skipped")
    cut = Segments(kept, file_keys)
    corrected = ledger.reconcile_direction(kept, file_keys, segments=cut)
    folded = shared.written(ledger.attach_fees(corrected, file_keys, segments=cut), "folded")
    rows = classify.to_transactions(folded, file_keys, segments=cut).join(names, file_keys)
    rows = shared.written(rows.withColumn("id", F.concat(F.lit("f"), F.col("file_idx").cast("string"), F.lit("-"), F.col("id"))), "transactions")
    banks = shared.written(statements.with_periods(told.drop("delimiter"), records, file_keys).join(names, file_keys), "banks")
    found = merge.statement_files(rows, keys).select(*file_keys, F.col("n_rows").alias("_rows"), "needs_ai")
    files = banks.join(found, file_keys, "left").withColumns({"n_rows": F.coalesce("_rows", F.lit(0)), "needs_ai": F.coalesce("needs_ai", F.lit(0))}).drop("_rows")
    merged = merge.remove_cross_file_duplicates(rows, tuple(keys))
    dated = banks.withColumns({c: F.col(c).try_cast("date") for c in ("period_start", "period_end")})
    warnings = merge.all_warnings(dated, records, corrected, folded, rows, keys, file_keys)
    return Statements(files, rows, merged, merge.merge_summary(rows, merged, keys, banks), warnings)
