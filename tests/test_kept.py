"""What lasts or goes out: overrides in versions, exports read back, pages, roll-ups that add up."""

import datetime as dt
from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import classify, enrich, export, metrics, rollup
from tallyspark.operators.overrides import Overrides


def chosen(spark, *rows):
    return spark.createDataFrame(rows, "account_id long, dedup_key string, category string, updated_at long")


def test_overrides_last_and_the_later_one_wins(spark, tmp_path):
    store = Overrides(spark, f"file://{tmp_path}/o", ["account_id"])
    assert store.versions() == [] and store.read().count() == 0
    assert store.update(chosen(spark, (1, "A", "hiburan", 5), (1, "B", "hiburan", 9), (2, "A", "hiburan", 5))) == 1
    assert store.update(chosen(spark, (1, "A", "groceries", 5), (1, "B", "groceries", 8), (3, "C", "tagihan", 1))) == 2
    read = lambda v=None: {(r["account_id"], r["dedup_key"]): r["category"] for r in store.read(v).collect()}
    assert read() == {(1, "A"): "groceries", (1, "B"): "hiburan", (2, "A"): "hiburan", (3, "C"): "tagihan"}
    assert read(1)[1, "A"] == "hiburan"
    # a run that died leaves a version without its marker: it counts for nothing, and its number is not used again
    store.read().write.parquet(f"file://{tmp_path}/o/v3")
    (tmp_path / "o" / "v3" / "_SUCCESS").unlink()
    assert store.versions() == [1, 2] and read()[3, "C"] == "tagihan"
    assert store.update(chosen(spark, (3, "C", "hiburan", 2))) == 4 and read()[3, "C"] == "hiburan"
    store.prune(1)
    assert store.versions() == [4]


@pytest.fixture
def tx(spark):
    said = ["KFC KOTA", "GAJI PT X", 'BELI "A", B', "TOP UP OVO", "NETFLIX COM", ""]
    rows = [(i % 3, i % 2, i, dt.date(2026, 1, 1) + dt.timedelta(days=i % 40), said[i % 6], M(1000 + 37 * i), "credit" if i % 6 == 1 else "debit", None if i % 5 == 0 else M(9000 - i)) for i in range(120)]
    df = spark.createDataFrame(rows, "account_id long, file_idx int, seq long, date date, description string, amount decimal(18,2), direction string, balance decimal(18,2)")
    return classify.classify(df).withColumn("file_name", F.concat(F.lit("f"), "file_idx"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_export_by_account_is_read_back(tx, spark, tmp_path):
    path = f"{tmp_path}/out"
    export.export_transactions(tx, path, ["account_id", "file_name"], parts=2)
    assert rows_of(export.read_export(spark, path)) == rows_of(export.export_columns(tx))
    folders = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part=")]
    assert 1 <= len(folders) <= 2 and all(len([*p.glob("*.csv")]) == 1 for p in folders)


@pytest.mark.parametrize("limit", [7, 50, 500])
def test_pages_are_the_rows_in_order(tx, spark, tmp_path, limit):
    tx.select("account_id", "file_idx", "seq", "date", "amount").write.parquet(f"{tmp_path}/tx")
    rows, order = spark.read.parquet(f"{tmp_path}/tx"), ["date", "account_id", "file_idx", "seq"]
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    index, last = metrics.page_index(rows, order, limit), None
    for n in range(-(-len(want) // limit) + 1):
        page = [tuple(r) for r in metrics.page_after(rows, order, last, limit).collect()]
        assert page == want[n * limit : (n + 1) * limit] == [tuple(r) for r in metrics.page_at(rows, order, index, n, limit).collect()]
        last = [dict(zip(rows.columns, page[-1], strict=True))[c] for c in order] if page else last


def test_all_metrics_of_added_rollups_are_those_of_the_rows(tx):
    keys = ["account_id"]
    parts = [rollup.rollup(tx.filter(F.col("file_idx") == i), keys) for i in (0, 1)]
    both = rollup.merged(parts, keys)
    of = [metrics.headline_metrics, metrics.qris_metrics, metrics.identification_metrics, metrics.ending_balance, metrics.by_category, metrics.by_merchant, metrics.by_month, metrics.by_day, metrics.by_weekday, metrics.detect_recurring, metrics.busiest_weekday, metrics.top_categories_with_other, metrics.daily_balance_series]
    for f in of:
        for k in (keys, []) if f in (metrics.headline_metrics, metrics.by_category, metrics.by_merchant) else (keys,):
            assert rows_of(f(both, k)) == rows_of(f(tx, k)), f.__name__
    assert rows_of(metrics.detect_anomalies(tx, keys, 3, both)) == rows_of(metrics.detect_anomalies(tx, keys, 3))
    assert metrics.headline_metrics(both.limit(0), []).first()["n"] == 0


def test_calls_are_tried_again_and_only_failed_ones_resumed(spark, tmp_path):
    calls = spark.createDataFrame([(a, b, 1, f"{a}-{b}") for a in range(4) for b in range(3)], "account_id long, batch int, n long, payload string")
    seen = str(tmp_path)

    def flaky(payload):
        """Fails at first; for some for ever."""
        import pathlib

        mark = pathlib.Path(seen, payload)
        mark.write_text((mark.read_text() if mark.exists() else "") + "x")
        if payload.endswith("-2") or (payload.endswith("-1") and len(mark.read_text()) < 2):
            raise TimeoutError(f"no answer to {payload}")
        return payload.upper()

    got = enrich.answered(calls, ["account_id"], flaky, tries=2, wait=0.01)
    out = {(r["account_id"], r["batch"]): (r["reply"], r["status"], r["tries"], r["reason"]) for r in got.collect()}
    for a in range(4):
        assert out[a, 0] == (f"{a}-0", "answered", 1, None) and out[a, 1] == (f"{a}-1", "answered", 2, None)
        assert out[a, 2] == (None, "failed", 2, f"TimeoutError: no answer to {a}-2")
    assert enrich.failures(got, ["account_id"]).count() == 4
    again = enrich.resumed(got, ["account_id"], lambda p: f"late {p}", tries=1).collect()
    assert len(again) == 12 and {(r["reply"], r["tries"]) for r in again if r["batch"] == 2} == {(f"late {a}-2", 3) for a in range(4)}
    assert (tmp_path / "0-0").read_text() == "x"  # what was answered is not asked again
