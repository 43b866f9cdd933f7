"""Rows that rules leave open go to an external classifier, one for each kind of description; corrections by hand come on top."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import dims, text
from tallyspark.operators.classify import needs_enrichment
from tallyspark.sources import shared

#: Rows in a call of the classifier; characters of a description, a merchant and a note that are used.
BATCH, LONGEST, MERCHANT, NOTE = 30, 300, 60, 120
#: Calls of a batch until it has failed, seconds before the second one, calls that a task has under way.
TRIES, WAIT, AT_ONCE = 3, 1.0, 3
REPLY = "array<struct<id:string,merchant:string,category:string,confidence:double,note:string>>"


def representatives(tx: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows that need enrichment one for each dedup key, the first in order."""
    rows = tx.filter(needs_enrichment()).withColumn("description", F.substring("description", 1, LONGEST))
    rows = rows.withColumn("dedup_key", text.dedup_key(F.col("description")))
    fields = [c for c in rows.columns if c not in (*keys, "dedup_key")]
    picked = rows.groupBy(*keys, "dedup_key").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "dedup_key", "_r.*")


def batches(reps: DataFrame, keys: list[str], size: int = BATCH, order: str = "seq") -> DataFrame:
    """reps in chunks of size for each key: batch, n, payload (a JSON array; what is unknown is left out)."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    qris = F.when(F.col("qris").isNotNull(), F.struct(F.col("qris.nmid").alias("nmid"), F.col("qris.acquirer").alias("acquirer"), F.col("qris.name_hint").alias("sisa_teks")))
    item = F.struct(F.col(order).cast("string").alias("id"), F.col("description").alias("keterangan"), F.round("amount").cast("long").alias("nominal"), F.when(F.col("direction") == "debit", "keluar").otherwise("masuk").alias("arah"), F.col("date").cast("string").alias("tanggal"), qris.alias("qris"))
    rows = reps.withColumn("_at", at).withColumn("batch", F.expr(f"_at div {size}").cast("int")).withColumn("_item", F.struct("_at", item.alias("item")))
    out = rows.groupBy(*keys, "batch").agg(F.sort_array(F.collect_list("_item")).alias("_items"), F.count("*").alias("n"))
    return out.select(*keys, "batch", "n", F.to_json(F.transform("_items", lambda x: x["item"])).alias("payload"))


def answered(calls: DataFrame, keys: list[str], classifier: Callable[[str], str], tries: int = TRIES, wait: float = WAIT, at_once: int = AT_ONCE) -> DataFrame:
    """calls(keys, batch, n, payload) with what became of each: reply, status (answered or failed), tries, reason.

    A call that raises is made again after wait, twice wait, and so on, tries times in all; then its batch is failed, with the last
    error as reason, and no other call suffers. Each task has at_once calls under way. The outcome is written: the service is
    called once, however often the answers are read."""
    kinds = dict(calls.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "batch int", f"n {kinds['n']}", "payload string", "reply string", "status string", "tries int", "reason string"])

    def call(payload: str) -> tuple[str | None, str, int, str | None]:
        reason = None
        for i in range(tries):
            if i:
                time.sleep(wait * 2 ** (i - 1))
            try:
                return classifier(payload), "answered", i + 1, None
            except Exception as e:  # noqa: BLE001 - whatever an outside service raises, the batch is reported and the others go on
                reason = f"{type(e).__name__}: {e}"
        return None, "failed", tries, reason

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for part in parts:
                got = pd.DataFrame([*pool.map(call, part["payload"])], columns=["reply", "status", "tries", "reason"], index=part.index)
                yield pd.concat([part, got.astype({"tries": "int32"})], axis=1)

    return shared.written(calls.select(*keys, "batch", "n", "payload").mapInPandas(run, schema), "answers")


def failures(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The batches that failed: (keys, batch, n, tries, reason)."""
    return answers.filter(F.col("status") == "failed").select(*keys, "batch", "n", "tries", "reason")


def resumed(answers: DataFrame, keys: list[str], classifier: Callable[[str], str], **how: float) -> DataFrame:
    """answers of an earlier run with its failed batches, and only these, called again; tries go on counting."""
    failed = answers.filter(F.col("status") == "failed")
    before = failed.select(*keys, "batch", F.col("tries").alias("_before"))
    again = answered(failed, keys, classifier, **how).join(before, [*keys, "batch"]).withColumn("tries", F.col("tries") + F.col("_before"))
    return answers.filter(F.col("status") != "failed").unionByName(again.drop("_before"))


def validated(replies: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """replies(keys, reply) to rows (keys, order, merchant, category, confidence, note): unknown categories are the last one,
    blank merchants unidentified, confidence 0 to 1 (0.5 if missing), texts cut. Unreadable replies give no row."""
    rows = replies.select(*keys, F.explode(F.from_json("reply", REPLY)).alias("r")).select(*keys, "r.*")
    name = F.substring(F.trim(F.coalesce("merchant", F.lit(""))), 1, MERCHANT)
    known = F.coalesce(F.col("category").isin([c[0] for c in dims.CATEGORIES]), F.lit(False))
    return rows.select(*keys, F.col("id").try_cast("long").alias(order), F.when(name == "", dims.UNIDENTIFIED).otherwise(name).alias("merchant"), F.when(known, F.col("category")).otherwise(dims.OTHER).alias("category"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))).alias("confidence"), F.substring("note", 1, NOTE).alias("note")).filter(F.col(order).isNotNull())


def expanded(tx: DataFrame, reps: DataFrame, results: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """tx with each result copied to all rows of its dedup key that needed it; rows corrected by hand stay."""
    found = reps.select(*keys, "dedup_key", order).join(results, [*keys, order]).select(*keys, "dedup_key", *[F.col(c).alias(f"_{c}") for c in ("merchant", "category", "confidence", "note")])
    rows = tx.withColumn("dedup_key", F.when(needs_enrichment(), text.dedup_key(F.substring("description", 1, LONGEST))))
    out = rows.join(found, [*keys, "dedup_key"], "left")
    hit = F.col("_category").isNotNull()
    return out.withColumns({**{c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("merchant", "category", "confidence", "note")}, "source": F.when(hit, "ai").otherwise(F.col("source"))}).select(tx.columns)


class Enriched(NamedTuple):
    """Transactions after enrichment, and what became of each call, failed ones with their reasons."""

    rows: DataFrame
    answers: DataFrame


def enriched(tx: DataFrame, keys: list[str], classifier: Callable[[str], str], order: list[str], overrides: DataFrame | None = None, answers: DataFrame | None = None, **how: float) -> Enriched:
    """The whole way: representatives, calls, checked answers, spread to all rows; corrections by hand before and after.

    Rows of a failed batch keep what the rules said. answers: the outcome of an earlier run over the same rows; then only its failed
    batches are called. how: tries, wait and at_once of answered()."""
    tx = tx if overrides is None else apply_overrides(tx, overrides, keys)
    reps = representatives(tx, keys, order)
    got = answered(batches(reps, keys, order=order[-1]), keys, classifier, **how) if answers is None else resumed(answers, keys, classifier, **how)
    out = expanded(tx, reps, validated(got, keys, order[-1]), keys, order[-1])
    return Enriched(out if overrides is None else apply_overrides(out, overrides, keys), got)


def enrich(tx: DataFrame, keys: list[str], classifier: Callable[[str], str], order: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """The rows of enriched()."""
    return enriched(tx, keys, classifier, order, overrides).rows


def apply_overrides(tx: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """overrides(keys, dedup_key, category): rows of these keys whose category differs get it, as corrected by hand."""
    fixed = overrides.select(*keys, "dedup_key", F.col("category").alias("_category"))
    out = tx.withColumn("dedup_key", text.dedup_key(F.col("description"))).join(fixed, [*keys, "dedup_key"], "left")
    hit = F.col("_category").isNotNull() & (F.col("_category") != F.col("category"))
    return out.withColumns({"category": F.when(hit, F.col("_category")).otherwise(F.col("category")), "source": F.when(hit, "manual").otherwise(F.col("source")), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "note": F.when(hit, "Dikoreksi manual").otherwise(F.col("note"))}).select(tx.columns)


def corrections(tx: DataFrame, chosen: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """chosen(keys, order, category, updated_at): corrections of single rows, as overrides of their dedup keys; the latest wins."""
    picked = tx.select(*keys, order, text.dedup_key(F.col("description")).alias("dedup_key")).join(chosen, [*keys, order])
    return picked.groupBy(*keys, "dedup_key").agg(F.max_by("category", "updated_at").alias("category"), F.max("updated_at").alias("updated_at"))


def set_override(tx: DataFrame, chosen: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """tx with all rows that share a dedup key with a corrected one set to its category by hand, whatever they had."""
    fixed = corrections(tx, chosen, keys, order).select(*keys, "dedup_key", F.col("category").alias("_category"))
    out = tx.withColumn("dedup_key", text.dedup_key(F.col("description"))).join(fixed, [*keys, "dedup_key"], "left")
    hit = F.col("_category").isNotNull()
    return out.withColumns({"category": F.coalesce("_category", "category"), "source": F.when(hit, "manual").otherwise(F.col("source")), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "note": F.when(hit, "Dikoreksi manual").otherwise(F.col("note"))}).select(tx.columns)


# Patterns of a plain guess, and what it answers.
GUESSES = [
    (("WRG", "WARUNG", "MKN", "NASI", "AYM", "GEPREK"), "Warung Makan Bu Sri", "makan_minum"),
    (("AMDK", "TIRTA", "AIR"), "Depot Air Tirta Jaya", "groceries"),
    (("TK ", "TOKO", "BANGUNAN", "MAJU"), "Toko Bangunan Maju", "rumah_tangga"),
]
NO_GUESS = ("Merchant QRIS Tidak Dikenal", "lainnya")


def guess(payload: str) -> str:
    """A deterministic classifier for tests and offline runs: by a few keywords."""
    out = []
    for item in json.loads(payload):
        said = item["keterangan"].upper()
        merchant, category = next(((m, c) for keys, m, c in GUESSES if any(k in said for k in keys)), NO_GUESS)
        out.append({"id": item["id"], "merchant": merchant, "category": category, "confidence": 0.7, "note": None})
    return json.dumps(out)
