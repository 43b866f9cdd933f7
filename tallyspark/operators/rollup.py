"""A mergeable roll-up of classified transactions, which the metrics derive from.

A row for each day, direction, category, merchant and kind of an account holds what sums and extremes need: rows, amounts and their
squares, first and last place, last balance, how many are identified. Roll-ups of more files are added with merged(); nothing is
read again. Every metric takes either transactions or a roll-up: a transaction is a roll-up of one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.classify import is_identified

ORDER = ("date", "file_idx", "seq")
GROUPS = ["date", "direction", "category", "merchant", "kind"]
#: Sums of a roll-up and their types.
SUMS = {"rows": "long", "amount": "decimal(38,2)", "squares": "decimal(38,4)", "identified": "long", "by_ai": "long", "nameless": "long", "nameless_amount": "decimal(38,2)"}


def place(df: DataFrame) -> Column:
    """The order of rows, by as much of (date, file_idx, seq) as there is."""
    return F.struct(*[F.col(c) for c in ORDER if c in df.columns])


def rolled(tx: DataFrame) -> DataFrame:
    """tx with the columns of a roll-up, as far as it has what they are made of; a roll-up as it is."""
    if {"rows", "squares", "low", "last"} <= {*tx.columns}:
        return tx
    at, a = place(tx), F.col("amount")
    made = {"rows": F.lit(1).cast("long"), "squares": (a * a).cast("decimal(38,4)"), "low": a, "high": a, "first": at, "last": at}
    if "balance" in tx.columns:
        made["balance_at"] = F.when(F.col("balance").isNotNull(), at)
    if "source" in tx.columns:
        made |= {"identified": is_identified().cast("long"), "by_ai": (F.col("source") == "ai").cast("long"), "nameless": F.col("no_merchant_info").cast("long"), "nameless_amount": F.when(F.col("no_merchant_info"), a).otherwise(0)}
    return tx.withColumns(made)


def rollup(tx: DataFrame, keys: list[str]) -> DataFrame:
    """tx(keys, date, direction, category, merchant, kind, amount, ...), classified, or a roll-up of it, in any parts, to one row for
    each of keys and GROUPS; with balances if tx has any. All sums are taken before the shuffle."""
    sums = [F.sum(c).cast(t).alias(c) for c, t in SUMS.items()]
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last")]
    balance = [F.max_by("balance", "balance_at").alias("balance"), F.max("balance_at").alias("balance_at")] if "balance" in tx.columns else []
    return rolled(tx).groupBy(*keys, *GROUPS).agg(*sums, *ends, *balance)


def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Roll-ups of different rows as one."""
    return rollup(reduce(DataFrame.unionByName, parts), keys)


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """The standard deviation of a whole, from its number, sum and sum of squares; null of none."""
    n, total, squares = (c.cast("double") for c in (n, total, squares))
    return F.try_divide(F.sqrt(F.greatest(F.lit(0.0), n * squares - total * total)), n)
