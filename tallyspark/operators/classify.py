"""Statement rows to classified transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dims, text
from tallyspark.functions.frames import sealed
from tallyspark.operators.segments import Segments

META = ("nmid", "mpan", "terminal_id", "reference", "acquirer", "name_hint")


def classify(df: DataFrame, merchants: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """df(description, direction, ...) with kind, qris, merchant, category, confidence, source, note, no_merchant_info added.

    Works row by row, in stages of columns so that no expression is evaluated twice: normalised text, kind and dictionary
    entry, then the decision. No filter on what comes out is pushed down into the stages (sealed). merchants: an ordered table of
    (merchant, category, keywords) in place of the default."""
    out = df.withColumn("_n", text.normalize(F.coalesce("description", F.lit(""))))
    n = F.col("_n")
    out = out.withColumns({"kind": text.detect_kind(n, F.col("direction")), "_dict": text.match_dictionary(n, merchants)})
    kind, found, name, of = F.col("kind"), F.col("_dict").isNotNull(), F.col("_dict")["merchant"], F.col("_dict")["category"]
    out = out.withColumn("qris", F.when(kind == "qris", text.qris_meta(n)))
    hint = F.col("qris")["name_hint"]
    by = F.lit(None).cast("struct<category:string,merchant:string,note:string>")
    for k, category, merchant, note in dims.KIND_CATEGORY:
        by = F.when(kind == k, F.struct(F.lit(category).alias("category"), F.lit(merchant).alias("merchant"), F.lit(note).alias("note"))).otherwise(by)
    transfers = kind.isin("transfer_in", "transfer_out")
    out = out.withColumns({"_by": by, "_party": F.when(transfers, text.extract_counterparty(n)), "_word": F.when(~found, text.match_category_keyword(n))})
    by, party, word = F.col("_by"), F.col("_party"), F.col("_word")
    decides = kind.isin(dims.DECIDING_KINDS)
    topped = F.when(kind == "topup", name)

    def answer(merchant: Column, category: Column, confidence: Column | float, source: Column | str, note: Column | str, nameless: bool = False) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(merchant.alias("merchant"), category.alias("category"), lit(confidence).cast("double").alias("confidence"), lit(source).alias("source"), lit(note).alias("note"), F.lit(nameless).alias("no_merchant_info"))

    nothing = F.lit(None).cast("string")
    decided = answer(
        F.when(kind == "fee", text.fee_label(n, by["merchant"])).otherwise(F.coalesce(topped, text.title_case(party), by["merchant"])),
        by["category"],
        F.when(topped.isNotNull() | party.isNotNull(), 0.85).otherwise(0.8),
        F.when(topped.isNotNull(), "dictionary").otherwise("rule"),
        by["note"],
    )
    result = (
        F.when((kind == "qris") & ~found & ~text.has_name_like_token(hint), answer(F.lit(dims.NO_NAME), F.lit(dims.OTHER), 0.5, "rule", "Statement tidak mencantumkan nama merchant", True))
        .when(decides, decided)
        .when(found, answer(name, F.when((kind == "qris") & (of == "topup_ewallet"), "makan_minum").otherwise(of), 0.95, "dictionary", "Cocok dengan kamus merchant"))
        .when(by.isNotNull(), answer(by["merchant"], by["category"], 0.85, "rule", by["note"]))
        .when(word.isNotNull(), answer(F.when(kind == "qris", text.title_case(hint)), word, 0.6, "rule", "Cocok dengan kata kunci kategori"))
        .when(F.col("direction") == "credit", answer(nothing, F.lit("pendapatan"), 0.35, "unknown", "Uang masuk, sumber belum teridentifikasi"))
        .otherwise(answer(nothing, F.lit(dims.OTHER), 0.1, "unknown", "Belum teridentifikasi"))
    )
    out = out.withColumn("_c", result)
    if "direction_confidence" in df.columns:
        low = F.when(F.col("direction_confidence") < 0.5, F.least(F.col("_c")["confidence"], F.lit(0.5))).otherwise(F.col("_c")["confidence"])
    else:
        low = F.col("_c")["confidence"]
    given = {"kind": kind, "qris": F.col("qris"), "confidence": low, **{c: F.col("_c")[c] for c in ("merchant", "category", "source", "note", "no_merchant_info")}}
    return sealed(out, [c for c in df.columns if c not in given], given)


def to_transactions(df: DataFrame, file_keys: list[str], order: str = "seq", segments: Segments | None = None) -> DataFrame:
    """classify() with an id from the row's place in its file, its date and its amount."""
    cut = segments or Segments(df, file_keys, order)
    out = classify(cut.place(cut.cut(df), "_place").drop("_segment"))
    return out.withColumn("id", F.concat(F.lit("tx-"), F.col("_place").cast("string"), F.lit("-"), F.col("date").cast("string"), F.lit("-"), F.round("amount").cast("long").cast("string"))).drop("_place")


def needs_enrichment() -> Column:
    return ~F.col("no_merchant_info") & ~F.col("source").isin("manual", "ai") & ((F.col("source") == "unknown") | (F.col("confidence") < 0.6))


def is_identified() -> Column:
    return (F.col("source") != "unknown") & (F.col("confidence") >= 0.5) & ~F.col("no_merchant_info")


def is_spending() -> Column:
    return (F.col("direction") == "debit") & ~F.col("category").isin(dims.NON_SPENDING)


def categories(spark) -> DataFrame:
    """The categories as a table: category, label, category_group, emoji. Nineteen rows, so it is broadcast in joins."""
    rows = F.array(*[F.struct(F.lit(i).alias("category"), F.lit(label).alias("label"), F.lit(g).alias("category_group"), F.lit(e).alias("emoji")) for i, label, g, e in dims.CATEGORIES])
    return spark.range(1).select(F.inline(rows))


def with_category(df: DataFrame) -> DataFrame:
    """df(category, ...) with label, category_group and emoji; unknown categories have those of the last one."""
    table = categories(df.sparkSession).withColumnRenamed("category", "_id")
    known = df.withColumn("_key", F.when(F.col("category").isin([c[0] for c in dims.CATEGORIES]), F.col("category")).otherwise(dims.OTHER))
    return known.join(F.broadcast(table), F.col("_key") == F.col("_id")).drop("_key", "_id")


def filter_transactions(df: DataFrame, category: str | None = None, direction: str | None = None, source_file: str | None = None, only_unclear: bool = False, query: str | None = None) -> DataFrame:
    """The rows that meet all given conditions; query: text within description, merchant or category label, in either case."""
    out = df
    for column, value in (("category", category), ("direction", direction), ("file_name", source_file)):
        out = out.filter(F.col(column) == value) if value is not None else out
    if only_unclear:
        out = out.filter((F.col("confidence") < 0.6) | (F.col("source") == "unknown"))
    if query and query.strip():
        q = F.lit(query.strip().lower())
        labelled = with_category(out)
        hit = F.contains(F.lower("description"), q) | F.contains(F.lower(F.coalesce("merchant", F.lit(""))), q) | F.contains(F.lower("label"), q)
        out = labelled.filter(hit).select(df.columns)
    return out
