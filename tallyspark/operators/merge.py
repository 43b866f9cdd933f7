"""Several statement files of an account as one: union, duplicates across files, overlaps, summaries and warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.values import spaced
from tallyspark.operators.classify import needs_enrichment
from tallyspark.sources import shared

ORDER = ["date", "file_idx", "seq"]
#: Files that share days with others up to which their table is broadcast.
MOST_FILES = 200_000


def union_statements(files: list[DataFrame], names: list[str]) -> DataFrame:
    """All rows of the files in the order given: file_idx, file_name, and ids that name the file."""
    parts = []
    for i, (df, name) in enumerate(zip(files, names, strict=True)):
        df = df.withColumns({"file_idx": F.lit(i), "file_name": F.lit(name)})
        parts.append(df.withColumn("id", F.concat(F.lit(f"f{i}-"), F.col("id"))) if "id" in df.columns else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def identity() -> list:
    """What makes a row the same transaction: date, direction, amount, balance and description (upper case, single spaces)."""
    said = F.trim(F.regexp_replace(spaced(F.upper("description")), " +", " "))
    return [F.col("date"), F.col("direction"), F.col("amount"), F.coalesce(F.col("balance").cast("string"), F.lit("-")).alias("balance_key"), said.alias("said")]


def file_days(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file_idx, period_start, period_end): the first and last day of each file's rows, whatever its heading says."""
    return df.groupBy(*keys, "file_idx").agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"))


def _pairs(files: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs a, b (structs) of an account's files whose periods share a day, a before b.

    Files meet by account and month, in the first month that both are in, so that years of statements make no pairs."""
    month = lambda c: F.trunc(c, "MM")
    dealt = files.withColumn("_month", F.explode(F.sequence(month("period_start"), month("period_end"), F.expr("interval 1 month"))))
    a, b = dealt.alias("a"), dealt.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_month"]]) & (F.col("a.file_idx") < F.col("b.file_idx"))
    meet = (F.col("a.period_start") <= F.col("b.period_end")) & (F.col("b.period_start") <= F.col("a.period_end")) & (F.col("a._month") == F.greatest(month("a.period_start"), month("b.period_start")))
    return a.join(b, same & meet).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))


def shared_days(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file_idx, spans): for each file that shares days with others of its account, the days of each meeting (first, last)."""
    span = F.struct(F.greatest("a.period_start", "b.period_start").alias("first"), F.least("a.period_end", "b.period_end").alias("last"))
    both = _pairs(files, keys).select(F.explode(F.array("a", "b")).alias("f"), span.alias("span"))
    return both.groupBy(*[F.col(f"f.{k}").alias(k) for k in [*keys, "file_idx"]]).agg(F.collect_set("span").alias("spans"))


def remove_cross_file_duplicates(df: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Rows without those that an earlier file of the account has too; repeats within one file stay.

    Only a row of a day that another file of its account covers too can be a duplicate. The days that files share are a table of one
    row for each file that shares any; it is broadcast up to MOST_FILES rows, so that all other rows stay where they are. Beyond
    that, every row is compared. Rows without a date always are."""
    spans = shared.written(shared_days(file_days(df, list(keys)), list(keys)), "spans")
    if spans.count() > MOST_FILES:
        return first_files(df, keys)
    marked = df.join(F.broadcast(spans), [*keys, "file_idx"], "left")
    day = F.col("date")
    doubtful = day.isNull() | F.coalesce(F.exists("spans", lambda s: day.between(s["first"], s["last"])), F.lit(False))
    return marked.filter(~doubtful).select(df.columns).union(first_files(marked.filter(doubtful).select(df.columns), keys))


def first_files(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of the first file of the account that has their identity.

    That file is an aggregate that is summed before the shuffle, joined back: a transaction that a third of all rows repeat is no
    window of its own. What is shuffled for an identity is 128 bits of hash, not its description, and rows of equal bits are
    taken for equal: the columns themselves are not compared again."""
    whole = [F.coalesce(c.cast("string"), F.lit("\0")) for c in identity()]
    keyed = df.withColumns({"_h1": F.xxhash64(*whole), "_h2": F.xxhash64(F.lit(1), *whole)})
    names = [*keys, "_h1", "_h2"]
    first = keyed.groupBy(*names).agg(F.min("file_idx").alias("_first"))
    same = reduce(lambda a, b: a & b, [keyed[n].eqNullSafe(first[n]) for n in names])
    return keyed.join(first, same & (keyed["file_idx"] == first["_first"]), "left_semi").select(df.columns)


def statement_files(df: DataFrame, keys: list[str], banks: DataFrame | None = None) -> DataFrame:
    """One row a file of transactions: rows, needs_ai, period; with banks(keys, file_idx, bank, bank_label), its bank and label too."""
    out = df.groupBy(*keys, "file_idx", "file_name").agg(F.count("*").alias("n_rows"), F.sum(needs_enrichment().cast("long")).alias("needs_ai"), F.min("date").alias("period_start"), F.max("date").alias("period_end"))
    return out if banks is None else out.join(banks.select(*keys, "file_idx", "bank", "bank_label"), [*keys, "file_idx"], "left")


def overlapping_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of an account's files whose periods share a day: file_a before file_b."""
    return _pairs(files, keys).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.file_name").alias("file_a"), F.col("b.file_name").alias("file_b"))


def merge_summary(before: DataFrame, after: DataFrame, keys: list[str], banks: DataFrame | None = None) -> DataFrame:
    """Per account: files, rows, duplicates removed, period, rows that need enrichment or name no merchant; with banks(keys, bank,
    bank_label), one row a file, its banks in order and their label too."""
    n = before.groupBy(*keys).agg(F.count("*").alias("n_before"), F.count_distinct("file_idx").alias("n_files"))
    out = after.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.sum(needs_enrichment().cast("long")).alias("needs_ai"), F.sum(F.col("no_merchant_info").cast("long")).alias("no_merchant_info"))
    out = out.join(n, keys).withColumn("duplicates_removed", F.col("n_before") - F.col("n_rows")).drop("n_before")
    return out if banks is None else out.join(bank_label(banks, keys), keys, "left")


def bank_label(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per account the bank's label, or how many banks its files are of: files(bank, bank_label)."""
    out = files.groupBy(*keys).agg(F.array_sort(F.collect_set("bank")).alias("banks"), F.collect_set("bank_label").alias("_labels"))
    label = F.when(F.size("_labels") == 1, F.get("_labels", 0)).otherwise(F.concat(F.size("_labels").cast("string"), F.lit(" bank berbeda")))
    return out.withColumn("bank_label", label).drop("_labels")


def all_warnings(files: DataFrame, records: DataFrame, corrected: DataFrame, folded: DataFrame, rows: DataFrame, keys: list[str], file_keys: list[str]) -> DataFrame:
    """Everything that reading and merging the files did, as one table (keys, file_idx, level, code, n): of each file directions
    corrected, rows skipped, fee rows merged, no rows; of each account (no file_idx) duplicates removed, files that overlap,
    several banks. files(file_keys, file_name, bank, bank_label, period_start, period_end as dates); records, corrected and folded as in
    file_warnings; rows: all transactions of all files before duplicates go."""
    own = file_warnings(files, records, corrected, folded, file_keys)
    gone = rows.groupBy(*keys).agg(F.count("*").alias("_n")).join(remove_cross_file_duplicates(rows, tuple(keys)).groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    merged = [
        ("info", "duplicates_removed", gone.select(*keys, (F.col("_n") - F.col("_m")).alias("n"))),
        ("info", "files_overlap", overlapping_files(files, keys).groupBy(*keys).agg(F.count("*").alias("n"))),
    ]
    parts = [own, mixed_banks(files, keys), *[df.filter(F.col("n") > 0).select(*keys, F.lit(level).alias("level"), F.lit(code).alias("code"), F.col("n").cast("long").alias("n")) for level, code, df in merged]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def statement_warnings(summary: DataFrame, overlaps: DataFrame, corrected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, level, code, n) of what the merge did: directions corrected, duplicates removed, files that overlap."""
    of = lambda df, level, code, n: df.filter(n > 0).select(*keys, F.lit(level).alias("level"), F.lit(code).alias("code"), n.cast("long").alias("n"))
    crossed = overlaps.groupBy(*keys).agg(F.count("*").alias("n"))
    fixed = corrected.groupBy(*keys).agg(F.sum(F.col("corrected").cast("long")).alias("n"))
    return of(fixed, "info", "direction_corrected", F.col("n")).union(of(summary, "info", "duplicates_removed", F.col("duplicates_removed"))).union(of(crossed, "info", "files_overlap", F.col("n")))


def file_warnings(files: DataFrame, records: DataFrame, corrected: DataFrame, folded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, level, code, n) of what reading each file did: directions corrected, rows skipped (no date or amount), fee
    rows merged into their payments, and files without any row. records have the flag skipped; corrected and folded are the
    records after reconcile_direction and after attach_fees."""
    count = lambda df, x: df.groupBy(*keys).agg(x.cast("long").alias("_n"))
    kept = count(records.filter(~F.col("skipped")), F.count("*"))
    merged = kept.join(count(folded, F.count("*")).withColumnRenamed("_n", "_m"), keys).withColumn("_n", F.col("_n") - F.col("_m"))
    found = [
        ("info", "direction_corrected", count(corrected, F.sum(F.col("corrected").cast("long")))),
        ("info", "rows_skipped", count(records, F.sum(F.col("skipped").cast("long")))),
        ("info", "fees_merged", merged),
        ("warn", "no_rows", files.join(kept, keys, "left_anti").withColumn("_n", F.lit(1).cast("long"))),
    ]
    return reduce(DataFrame.union, [df.filter(F.col("_n") > 0).select(*keys, F.lit(level).alias("level"), F.lit(code).alias("code"), F.col("_n").alias("n")) for level, code, df in found])


def mixed_banks(files: DataFrame, keys: list[str]) -> DataFrame:
    """A warning (keys, level, code, n) where the files that are merged come from several banks: how many."""
    return bank_label(files, keys).filter(F.size("banks") > 1).select(*keys, F.lit("warn").alias("level"), F.lit("mixed_banks").alias("code"), F.size("banks").cast("long").alias("n"))


def chronological(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with its place in the account's order of date, file and row."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)))
