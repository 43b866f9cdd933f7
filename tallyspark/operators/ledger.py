"""Order-dependent corrections of a file's rows: direction from the running balance, fees folded into their payment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.values import spaced
from tallyspark.operators import classify
from tallyspark.operators.segments import Segments

MONEY = "decimal(18,2)"
#: A fee is at most so much, and at most this share of what it belongs to.
MOST_FEE, MOST_SHARE = 25_000, 0.1


def reconcile_direction(df: DataFrame, file_keys: list[str], order: str = "seq", direction: str = "direction", segments: Segments | None = None) -> DataFrame:
    """df(amount, balance, direction, ...) with the direction that the change of the balance shows, where it matches the amount
    (within 1): direction, direction_confidence 1, corrected. Only the row right before counts, and only if both have a balance."""
    cut = segments or Segments(df, file_keys, order)
    out = cut.before(cut.cut(df), "_before", ["balance"])
    out = out.withColumn("_change", F.col("balance") - F.col("_before.balance"))
    out = out.withColumn("_sure", F.coalesce(F.abs(F.abs(F.col("_change")) - F.col("amount")) <= 1, F.lit(False)))
    shown = F.when(F.col("_change") >= 0, "credit").otherwise("debit")
    before = F.col("direction_confidence") if "direction_confidence" in df.columns else F.lit(0.9)
    new = F.when(F.col("_sure"), shown).otherwise(F.col(direction))
    out = out.withColumns({"corrected": F.col("_sure") & (shown != F.col(direction)), "direction_confidence": F.when(F.col("_sure"), 1.0).otherwise(before), "direction": new})
    return out.drop("_before", "_change", "_sure", "_segment")


def attach_fees(df: DataFrame, file_keys: list[str], order: str = "seq", segments: Segments | None = None) -> DataFrame:
    """Fee rows folded into the row they follow: a debit of the same day and description, smaller, at most MOST_FEE and at most
    MOST_SHARE of the growing amount. The row keeps its place; amount and fee grow, the balance is the last fee row's.

    Rows that could be in one chain are an island, named by its first row, also where a segment of the file ends within it. A row
    that is surely alone, as nearly all are, passes untouched; only the others meet by island. Islands are as short as the chains
    of equal rows in one file."""
    cut = segments or Segments(df, file_keys, order)
    df = df if "fee" in df.columns else df.withColumn("fee", F.lit(None).cast(MONEY))
    out = cut.cut(df).withColumn("_same", F.upper(F.trim(F.regexp_replace(spaced(F.col("description")), " +", " "))))
    out = cut.before(out, "_before", ["date", "direction", "_same"])
    of = F.col("_before")
    joined = (of["date"] == F.col("date")) & (of["direction"] == "debit") & (F.col("direction") == "debit") & (of["_same"] == F.col("_same"))
    out = out.withColumn("_new", ~F.coalesce(joined, F.lit(False)))
    out = cut.last(out, "_island", F.when(F.col("_new"), F.col(order)))
    out = out.withColumn("_alone", F.col("_new") & F.coalesce(F.lead("_new").over(cut.window()), F.lit(False)))
    chains = out.filter(~F.col("_alone")).withColumn("_row", F.struct(F.col(order).alias("_at"), *[F.col(c) for c in df.columns]))
    islands = chains.groupBy(*file_keys, "_island").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    first = F.slice("_rows", 1, 1)

    def fold(done, row):
        parent = F.element_at(done, -1)
        is_fee = (row["amount"] < parent["amount"]) & (row["amount"] <= MOST_FEE) & (row["amount"] <= parent["amount"] * F.lit(str(MOST_SHARE)).cast("decimal(3,2)"))
        grown = parent.withField("amount", (parent["amount"] + row["amount"]).cast(MONEY)).withField("fee", (F.coalesce(parent["fee"], F.lit(0).cast(MONEY)) + row["amount"]).cast(MONEY)).withField("balance", F.coalesce(row["balance"], parent["balance"]))
        return F.when(is_fee, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(row)))

    folded = F.when(F.size("_rows") == 1, F.col("_rows")).otherwise(F.aggregate(F.slice("_rows", F.lit(2), F.size("_rows")), first, fold))
    return out.filter("_alone").select(df.columns).union(islands.select(F.explode(folded).alias("_r")).select("_r.*").select(df.columns))


def balance_reconciliation_check(df: DataFrame, file_keys: list[str], order: str = "seq") -> DataFrame:
    """For each file: opening (first balance without the first amount), closing, what the amounts add up to, and whether they agree."""
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    got = df.groupBy(*file_keys).agg(F.min_by(F.col("balance") - signed, order).alias("opening"), F.max_by("balance", order).alias("closing"), F.sum(signed).alias("moved"))
    return got.withColumn("balanced", F.abs(F.col("opening") + F.col("moved") - F.col("closing")) <= F.lit("0.01").cast(MONEY))


def payment_gaps(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df(date, merchant, ...) with the days since the merchant's payment before; null for its first."""
    return df.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*keys, "merchant").orderBy(*order))))


def transactions(df: DataFrame, file_keys: list[str], order: str = "seq") -> DataFrame:
    """The whole way from raw rows: reconcile, fold fees, classify. Files are cut once for all steps."""
    cut = Segments(df, file_keys, order)
    return classify.to_transactions(attach_fees(reconcile_direction(df, file_keys, order, segments=cut), file_keys, order, cut), file_keys, order, cut)
