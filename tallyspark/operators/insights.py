"""Findings in words from an account's metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dims, values
from tallyspark.operators import metrics
from tallyspark.operators.rollup import rollup
from tallyspark.sources import shared


def filled(template: str, parts: dict[str, Column]) -> Column:
    """A template's text with columns in place of the names in braces."""
    return F.concat(*[parts[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if x])


def build_insights(tx: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, code, tone, title, body): up to ten findings for each key, in order, each only if its figures bear it.

    tx is read twice: for its roll-up, which is written and which all figures come from, and for the anomalies among its rows. The
    parts are one row for each key and join on it; the rules are one array of expressions on the joined row."""
    c, rp, said = F.col, values.rupiah, lambda x: F.col(x).cast("string")
    rows, tx = tx, shared.written(rollup(tx, keys), "rollup")
    recurring = metrics.detect_recurring(tx, keys)
    first = F.min(F.struct((-c("monthly_estimate")).alias("by"), "merchant", "avg_amount", "interval_days")).alias("recurring_first")
    odd = F.coalesce("merchant", F.substring("description", 1, 40)).alias("odd_name")
    parts = [
        metrics.qris_metrics(tx, keys),
        metrics.identification_metrics(tx, keys),
        metrics.ranked(metrics.by_category(tx, keys), keys, [c("total").desc(), c("category")], 1).select(*keys, *[c(x).alias(f"top_{x}") for x in ("label", "emoji", "share", "total", "n")]),
        metrics.most_frequent_merchant(tx, keys).select(*keys, *[c(x).alias(f"often_{x}") for x in ("merchant", "n", "average", "total")]),
        metrics.recurring_total(recurring, keys).select(*keys, "monthly_total", "n_tentative", c("n").alias("recurring_n")),
        recurring.groupBy(*keys).agg(first),
        metrics.busiest_weekday(tx, keys).select(*keys, *[c(x).alias(f"busy_{x}") for x in ("label", "total", "n", "average")]),
        metrics.detect_anomalies(rows, keys, 1, tx).select(*keys, odd, *[c(x).alias(f"odd_{x}") for x in ("amount", "date", "ratio", "label")]),
    ]
    whole = metrics.headline_metrics(tx, keys)
    for part in parts:
        whole = whole.join(part, keys, "left")

    def found(code: str, test: Column, tone: Column | str, which: str, **parts: Column) -> Column:
        title, body = (filled(t, parts).alias(n) for t, n in zip(dims.FINDINGS[which], ("title", "body"), strict=True))
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), (tone if isinstance(tone, Column) else F.lit(tone)).alias("tone"), title, body))

    def either(code: str, test: Column, tone: Column | str, first: tuple[Column, str], other: str, **parts: Column) -> Column:
        """One wording where its own test holds too, else the other."""
        return F.coalesce(found(code, test & first[0], tone, first[1], **parts), found(code, test, tone, other, **parts))

    nameless = c("no_merchant_info_count")
    fixable = c("n") - nameless
    clear = F.when(fixable > 0, c("identified_share") * c("n") / fixable).otherwise(1.0)
    saved, top, odd = c("savings_rate"), c("top_share"), c("odd_ratio")
    a, b = c("top_total").cast("double"), c("top_n").cast("double")
    lead = {x: c(f"recurring_first.{x}") for x in ("merchant", "avg_amount", "interval_days")}
    rules = F.array(
        F.coalesce(
            found("cash_flow", c("net") < 0, "critical", "deficit", gap=rp(F.abs(c("net"))), expense=rp(c("expense")), income=rp(c("income"))),
            either("cash_flow", c("income") > 0, F.when(saved >= 0.2, "good").when(saved >= 0.1, "neutral").otherwise("warning"), (saved >= 0.2, "saving_good"), "saving_low", rate=values.persen(saved), net=rp(c("net")), income=rp(c("income"))),
        ),
        either("top_category", top >= 0.15, F.when(top >= 0.4, "warning").otherwise("neutral"), (top >= 0.4, "top_large"), "top", emoji=c("top_emoji"), label=c("top_label"), share=values.persen(top), total=rp(c("top_total")), n=said("top_n"), average=rp(F.try_divide(a, b))),
        found("frequent_merchant", c("often_merchant").isNotNull(), "neutral", "frequent", merchant=c("often_merchant"), n=said("often_n"), average=rp(c("often_average")), total=rp(c("often_total"))),
        either(
            "recurring", c("recurring_n") > 0, F.when(c("monthly_total") > c("expense") * F.lit("0.15").cast("decimal(3,2)"), "warning").otherwise("neutral"), (c("n_tentative") > 0, "recurring_tentative"), "recurring",
            n=said("recurring_n"), monthly=rp(c("monthly_total")), merchant=lead["merchant"], average=rp(lead["avg_amount"]), interval=lead["interval_days"].cast("string"), tentative=said("n_tentative"),
        ),
        found("pace", c("days") >= 7, "neutral", "pace", daily=rp(c("avg_daily_expense")), month=rp(c("avg_daily_expense") * 30)),
        found("busiest_weekday", (c("busy_total") > 0) & (c("days") >= 14), "neutral", "busiest", label=c("busy_label"), total=rp(c("busy_total")), n=said("busy_n"), average=rp(c("busy_average"))),
        found("anomaly", c("odd_amount").isNotNull(), "warning", "anomaly", amount=rp(c("odd_amount")), name=c("odd_name"), day=values.tanggal(c("odd_date")), ratio=values.tenths(odd), label=c("odd_label")),
        either("qris", c("qris_count") > 0, "neutral", (c("ai_identified") > 0, "qris_ai"), "qris", n=said("qris_count"), total=rp(c("qris_total")), share=values.persen(c("qris_count") / c("n")), ai=said("ai_identified")),
        found("no_merchant_info", nameless > 0, F.when(nameless / c("n") > 0.4, "warning").otherwise("neutral"), "nameless", n=said("no_merchant_info_count"), total=rp(c("no_merchant_info_total")), share=values.persen(nameless / c("n"))),
        found("unclear", (fixable > 0) & (clear < 0.75), "warning", "unclear", share=values.persen(1 - clear)),
    )
    return whole.select(*keys, F.posexplode(F.array_compact(rules)).alias("ord", "i")).select(*keys, "ord", "i.*")
