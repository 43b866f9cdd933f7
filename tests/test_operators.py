"""Operators on small golden tables."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.operators import classify, enrich, export, insights, ledger, merge, metrics
from tallyspark.sources import statements

SCHEMA = "account_id long, file_idx int, seq long, date date, description string, amount decimal(18,2), direction string, balance decimal(18,2)"
D = dt.date


def rows(spark, *given):
    return spark.createDataFrame([(1, f, i, d, s, Decimal(a), w, None if b is None else Decimal(b)) for i, (f, d, s, a, w, b) in enumerate(given)], SCHEMA)


def test_direction_follows_the_balance(spark):
    df = rows(spark, (0, D(2026, 1, 1), "a", 100, "debit", 1000), (0, D(2026, 1, 1), "b", 500, "debit", 1500), (0, D(2026, 1, 2), "c", 200, "debit", 1300), (0, D(2026, 1, 2), "d", 7, "debit", None))
    out = ledger.reconcile_direction(df, ["account_id"]).orderBy("seq").collect()
    assert [(r["direction"], r["direction_confidence"], r["corrected"]) for r in out] == [("debit", 0.9, False), ("credit", 1.0, True), ("debit", 1.0, False), ("debit", 0.9, False)]


def test_fees_fold_in_chains(spark):
    day = D(2026, 4, 1)
    df = rows(spark, (0, day, "TRF X", 90000, "debit", 100), (0, day, "trf  x", 2500, "debit", 90), (0, day, "TRF X", 6000, "debit", 80), (0, day, "TRF X", 20000, "debit", 70), (0, day, "TRF Y", 500, "debit", 60))
    out = ledger.attach_fees(df, ["account_id"]).orderBy("seq").collect()
    assert [(int(r["amount"]), r["fee"] and int(r["fee"]), int(r["balance"])) for r in out] == [(98500, 8500, 80), (20000, None, 70), (500, None, 60)]
    assert sum(r["amount"] for r in out) == sum(r["amount"] for r in df.collect())


def test_duplicates_go_across_files_only(spark):
    a = (0, D(2026, 1, 1), "KFC", 10, "debit", 5)
    df = rows(spark, a, a, (1, *a[1:]), (1, D(2026, 1, 2), "KFC", 10, "debit", 5))
    assert [r["seq"] for r in merge.remove_cross_file_duplicates(df).orderBy("seq").collect()] == [0, 1, 3]
    assert merge.remove_cross_file_duplicates(df.limit(0)).count() == 0


def test_classification(spark):
    df = rows(
        spark,
        (0, D(2026, 1, 1), "QRIS INDOMARET CIPETE", 1, "debit", None), (0, D(2026, 1, 1), "QRIS 123456789012 GOPAY", 1, "debit", None), (0, D(2026, 1, 1), "Penarikan tunai di ATM - RS CONTOH", 1, "debit", None),
        (0, D(2026, 1, 1), "XYZZY", 1, "debit", None), (0, D(2026, 1, 1), None, 1, "credit", None), (0, D(2026, 1, 1), "QRIS 456042#9360000200122788552", 1, "debit", None), (0, D(2026, 1, 1), "TOKOPEDIA TIKTOK SHOP", 1, "debit", None),
    )
    out = [(r["kind"], r["merchant"], r["category"], r["source"]) for r in classify.classify(df).orderBy("seq").collect()]
    assert out == [
        ("qris", "Indomaret", "groceries", "dictionary"), ("qris", "GoPay", "makan_minum", "dictionary"), ("withdrawal", "Tarik Tunai", "tarik_tunai", "rule"), ("other", None, "lainnya", "unknown"), ("other", None, "pendapatan", "unknown"),
        ("qris", "QRIS tanpa nama merchant", "lainnya", "rule"), ("other", "Tokopedia", "belanja_online", "dictionary"),
    ]


def test_recurring_payments(spark):
    weekly = [(0, D(2026, 4, 1) + dt.timedelta(7 * i), "QRIS FAMILYMART", 20000 + i, "debit", None) for i in range(3)]
    monthly = [(0, D(2026, 4 + i, 2), "MONTHLY FEE ATM", 3000 + 500 * i, "debit", None) for i in range(2)]
    cash = [(0, D(2026, 4 + i, 3), "TARIK TUNAI", 300000, "debit", None) for i in range(2)]
    out = metrics.detect_recurring(classify.classify(rows(spark, *weekly, *monthly, *cash)), ["account_id"]).collect()
    assert {r["merchant"]: (r["occurrences"], r["interval_days"], r["tentative"]) for r in out} == {"FamilyMart": (3, 7, False), "Monthly Fee ATM": (2, 30, True)}


def test_metrics_by_account_add_up(spark):
    tx = classify.classify(rows(spark, (0, D(2026, 1, 1), "GAJI", 1000, "credit", 1000), (0, D(2026, 1, 3), "KFC", 100, "debit", 900), (0, D(2026, 1, 4), "TOP UP OVO", 50, "debit", None)))
    r = metrics.headline_metrics(tx, ["account_id"]).first()
    assert (r["income"], r["expense"], r["net"], r["days"], r["savings_rate"], r["avg_daily_expense"]) == (1000, 150, 850, 4, 0.85, 25.0)
    assert metrics.headline_metrics(tx, []).first()["net"] == 850
    assert metrics.by_weekday(tx, ["account_id"]).count() == 7
    assert metrics.ending_balance(tx, ["account_id"]).first()["ending_balance"] == 900
    assert [r["code"] for r in insights.build_insights(tx, ["account_id"]).orderBy("ord").collect()][:2] == ["cash_flow", "top_category"]


def test_enrichment_spreads_and_survives_failures(spark):
    said = [(0, D(2026, 1, 1 + i), f"QRIS 12345678901{i} WRG MKN", 10, "debit", None) for i in range(3)]
    tx = classify.classify(rows(spark, *said))
    out = enrich.enrich(tx, ["account_id"], enrich.guess, ["date", "seq"])
    assert {(r["merchant"], r["source"]) for r in out.collect()} == {("Warung Makan Bu Sri", "ai")}

    def broken(payload):
        raise OSError("no answer")

    assert {r["source"] for r in enrich.enrich(tx, ["account_id"], broken, ["date", "seq"]).collect()} == {"unknown"}
    overrides = spark.createDataFrame([(1, "QRIS # WRG MKN", "donasi_zakat")], "account_id long, dedup_key string, category string")
    assert {(r["category"], r["source"]) for r in enrich.enrich(tx, ["account_id"], enrich.guess, ["date", "seq"], overrides).collect()} == {("donasi_zakat", "manual")}


def test_delimited_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿Bank Mandiri\nPeriode 01/02/2026 s/d 28/02/2026\n\nTanggal;Keterangan;Debit;Kredit;Saldo\n03/02/2026;MIXUE;22.000,00;;3.478.000,00\n04/02/2026;\"GAJI; FEB\";;5.000.000,00;8.478.000,00\nx;y;;;\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    lines = statements.read_statement_text(spark, [str(tmp_path)])
    out = statements.csv_records(lines, ["file_name"]).orderBy("seq").collect()
    assert [(r["date"], r["description"], r["amount"], r["direction"], r["balance"], r["skipped"]) for r in out] == [
        (D(2026, 2, 3), "MIXUE", 22000, "debit", 3478000, False), (D(2026, 2, 4), "GAJI; FEB", 5000000, "credit", 8478000, False), (None, "y", None, "credit", None, True),
    ]
    assert statements.statement_files(lines, ["file_name"]).first()["bank"] == "mandiri"


def test_lines_with_continuations(spark):
    given = [(1, "PERIODE JANUARI 2026"), (2, "05/01 BELANJA 45.000,00 DB 1.955.000,00"), (3, "TOKO MAJU JAYA"), (4, "06/01 GAJI 1.500.000,00 CR 3.455.000,00"), (5, "Halaman 1")]
    cells = lambda t: [(c, 50.0 * i) for i, c in enumerate(t.split(" "))] if t[:1] == "0" else [(t, 50.0)]
    df = spark.createDataFrame([("f", i, t, cells(t)) for i, t in given], "file_name string, line_no int, text string, cells array<struct<str:string,x:double>>")
    out = statements.parse_statement_lines(df, ["file_name"]).orderBy("seq").collect()
    assert [(r["date"], r["description"], r["amount"], r["direction"], r["balance"]) for r in out] == [(D(2026, 1, 5), "BELANJA TOKO MAJU JAYA", 45000, "debit", 1955000), (D(2026, 1, 6), "GAJI", 1500000, "credit", 3455000)]


def test_export_is_quoted(spark, tmp_path):
    tx = classify.classify(rows(spark, (0, D(2026, 1, 1), 'KFC "A"', "10.6", "debit", None))).withColumn("file_name", F.lit("f.csv"))
    export.export_transactions(tx, str(tmp_path / "out"))
    said = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert '"2026-01-01","KFC ""A""","KFC","Makan & Minum","keluar","11","","Kamus","0.95","f.csv"' in said


def test_a_late_period_gives_its_year(spark):
    from tallyspark.sources import statements

    said = [f"Catatan {i}" for i in range(40)] + ["Periode: 01/03/2021 - 31/03/2021", "05/03 BELANJA 10.000,00 90.000,00"]
    lines = spark.createDataFrame([("f", i, t, []) for i, t in enumerate(said)], "file string, line_no int, text string, cells array<struct<str:string,x:double>>")
    assert [str(r["date"]) for r in statements.parse_statement_lines(lines, ["file"]).collect()] == ["2021-03-05"]


def test_fields_of_a_wide_file_are_not_cut(spark):
    from tallyspark.sources import statements

    more = ";".join(f"x{i}" for i in range(40))
    said = [f"Tanggal;Keterangan;{more};Debit;Kredit;Saldo", f"03/02/2026;MIXUE;{more};22.000,00;;3.478.000,00"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(said)], "file string, line_no int, text string")
    assert [(r["description"], r["amount"], r["balance"]) for r in statements.csv_records(lines, ["file"]).collect()] == [("MIXUE", 22000, 3478000)]


def test_files_overlap_by_day(spark):
    files = [("a", 0, D(2026, 1, 5), D(2026, 3, 31)), ("b", 1, D(2026, 3, 31), D(2026, 4, 30)), ("c", 2, D(2026, 2, 1), D(2026, 2, 1)), ("d", 3, D(2026, 5, 1), D(2026, 5, 31)), ("e", 4, D(2025, 1, 1), D(2026, 12, 31))]
    df = spark.createDataFrame([(1, *f) for f in files] + [(2, *files[0]), (2, *files[1])], "account_id long, file_name string, file_idx int, period_start date, period_end date")
    got = {(r["account_id"], r["file_a"], r["file_b"]) for r in merge.overlapping_files(df, ["account_id"]).collect()}
    assert got == {(1, "a", "b"), (1, "a", "c"), (1, "a", "e"), (1, "b", "e"), (1, "c", "e"), (1, "d", "e"), (2, "a", "b")}


def test_wide_spaces_are_white_space(spark):
    given = ["Rp\u00a025.000,00", "\u00a0(1.000,00)\u2003", "IDR\u202f7"]
    from tallyspark.functions import values

    df = spark.createDataFrame([(g,) for g in given], "s string")
    assert [int(r["v"]) for r in df.select(values.parse_amount(F.col("s")).alias("v")).collect()] == [25000, -1000, 7]
    assert df.limit(1).select(values.find_date(F.lit("5\u00a0Jan\u00a02026"))["iso"].alias("d")).first()["d"] == "2026-01-05"
    twice = rows(spark, (0, D(2026, 1, 1), "KFC\u00a0 A", 10, "debit", 5), (1, D(2026, 1, 1), "kfc a", 10, "debit", 5))
    assert merge.remove_cross_file_duplicates(twice).count() == 1


def test_warnings_of_files(spark):
    records = rows(spark, (0, D(2026, 1, 1), "A", 90000, "debit", 100000), (0, D(2026, 1, 1), "A", 2500, "debit", 97500), (0, D(2026, 1, 2), "B", 500, "debit", 98000)).withColumn("skipped", F.lit(False))
    skipped = records.limit(1).withColumn("skipped", F.lit(True))
    fixed = ledger.reconcile_direction(records, ["account_id"])
    files = spark.createDataFrame([(1, "bca", "Bank BCA"), (2, "bri", "Bank BRI")], "account_id long, bank string, bank_label string")
    out = merge.file_warnings(files, records.union(skipped), fixed, ledger.attach_fees(fixed, ["account_id"]), ["account_id"])
    assert {(r["account_id"], r["level"], r["code"], r["n"]) for r in out.collect()} == {(1, "info", "direction_corrected", 1), (1, "info", "rows_skipped", 1), (1, "info", "fees_merged", 1), (2, "warn", "no_rows", 1)}
    assert [(r["code"], r["n"]) for r in merge.mixed_banks(files.withColumn("owner", F.lit(1)), ["owner"]).collect()] == [("mixed_banks", 2)]


def test_results_do_not_depend_on_where_files_are_cut(spark, monkeypatch):
    """Directions, folded fees and places of files cut into a few rows each, against the rules applied row by row."""
    import random
    from decimal import Decimal

    from tallyspark.operators import segments

    rng, given = random.Random(3), []
    for f, n in (("a", 61), ("b", 7), ("c", 1), ("d", 25)):
        balance, day, said = Decimal(100000), 1, "x"
        for i in range(n):
            if rng.random() < 0.5:
                day, said = day + rng.randrange(2), rng.choice(("Transfer X", "transfer  x ", "BELI"))
            amount = Decimal(rng.choice((2500, 500, 6500, 90000, 150000)))
            direction = rng.choice(("debit", "debit", "debit", "credit"))
            balance += amount if direction == "credit" else -amount
            shown = None if rng.random() < 0.2 else balance + (0 if rng.random() < 0.8 else 7)
            given.append((f, 10 * i, D(2026, 1, 1 + day % 28), said, amount, rng.choice(("debit", direction)), shown))
    df = spark.createDataFrame(given, "file string, seq long, date date, description string, amount decimal(18,2), direction string, balance decimal(18,2)").repartition(4)

    want, places = {}, {}
    for f in "abcd":
        done, before = [], None
        for _, seq, date, said, amount, direction, balance in [r for r in given if r[0] == f]:
            if before is not None and balance is not None and abs(abs(balance - before) - amount) <= 1:
                direction = "credit" if balance >= before else "debit"
            before = balance
            same = " ".join(said.upper().split())
            p = done[-1] if done else None
            if p and p["date"] == date and p["direction"] == direction == "debit" and p["same"] == same and amount < p["amount"] and amount <= 25000 and amount <= p["amount"] * Decimal("0.1"):
                p |= {"amount": p["amount"] + amount, "fee": (p["fee"] or 0) + amount, "balance": p["balance"] if balance is None else balance}
            else:
                done.append({"seq": seq, "date": date, "direction": direction, "same": same, "amount": amount, "fee": None, "balance": balance})
        want |= {(f, p["seq"]): (p["amount"], p["fee"], p["balance"], p["direction"]) for p in done}
        places |= {(f, p["seq"]): f"tx-{i}-{p['date']}-{int(p['amount'])}" for i, p in enumerate(done)}
    assert sum(v[1] is not None for v in want.values()) >= 5
    for n in (1 << 20, 6, 3, 1):
        monkeypatch.setattr(segments, "ROWS", n)
        out = ledger.transactions(df, ["file"]).collect()
        assert {(r["file"], r["seq"]): (r["amount"], r["fee"], r["balance"], r["direction"]) for r in out} == want, n
        assert {(r["file"], r["seq"]): r["id"] for r in out} == places and len(out) == len(want)


def test_gaps_that_deviate_by_half_the_pace_are_told_as_sql_tells_them(spark):
    import datetime

    import duckdb

    all_gaps = [[21, 18, 17, 3, 6, 23, 21, 13, 4, 14], [28, 12, 21, 18, 19, 6, 12, 4], [23, 8, 22, 3, 18, 12, 5, 20, 21], [1, 7, 7, 9], [7, 21], [5, 15], [9, 3], [0, 0, 30, 30, 30]]
    given = []
    for i, gaps in enumerate(all_gaps):
        day = datetime.date(2020, 1, 1)
        for at, gap in enumerate([0, *gaps]):
            day += datetime.timedelta(gap)
            given.append((i, at, day, "debit", "hiburan", "Netflix", "qris"))
    df = spark.createDataFrame(given, "account_id long, seq long, date date, direction string, category string, merchant string, kind string").withColumn("amount", F.lit(50).cast("decimal(18,2)"))
    got = {r["account_id"] for r in metrics.detect_recurring(df, ["account_id"]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, place INTEGER, day DATE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [g[:3] for g in given])
    sql = "SELECT i FROM (SELECT i, day - lag(day) OVER (PARTITION BY i ORDER BY day, place) AS gap FROM t) GROUP BY i HAVING avg(gap) BETWEEN 5 AND 45 AND stddev_pop(gap) <= avg(gap) * 0.5"
    assert got == {i for (i,) in con.execute(sql).fetchall()} and 0 not in got and 3 in got
