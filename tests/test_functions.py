"""Golden values of scalar functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text, values


def one(spark, column, *args):
    row = spark.range(1).select(*[F.lit(a).cast("string").alias(f"a{i}") for i, a in enumerate(args)])
    return row.select(column(*[F.col(f"a{i}") for i in range(len(args))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "value"),
    [("1.234.567,89", "1234567.89"), ("25.000,00", "25000"), ("1.000", "1000"), ("999", "999"), ("Rp 350.000,00", "350000"), ("1,234,567.89", "1234567.89"), ("1,234", "1234"), ("1234.56", "1234.56"), ("-25.000,00", "-25000"), ("25.000,00-", "-25000"), ("(25.000,00)", "-25000"), ("QRIS", None), ("", None), ("abc123", None), (None, None)],
)
def test_parse_amount(spark, raw, value):
    assert one(spark, values.parse_amount, raw) == (None if value is None else Decimal(value))


@pytest.mark.parametrize(("raw", "is_one"), [("25.000,00", True), ("1234", True), ("1234567890123", False), ("2026", False), ("QRIS", False), ("", False)])
def test_looks_like_amount(spark, raw, is_one):
    assert one(spark, values.looks_like_amount, raw) is is_one


@pytest.mark.parametrize(("raw", "iso"), [("05/01/2026", "2026-01-05"), ("05-01-26", "2026-01-05"), ("2026-01-05", "2026-01-05"), ("5 Jan 2026", "2026-01-05"), ("5 Januari 2026", "2026-01-05"), ("05 JAN", "????-01-05"), ("32/01/2026", None), ("05/13/2026", None), ("", None)])
def test_find_date(spark, raw, iso):
    found = one(spark, values.find_date, raw)
    assert (found and found["iso"]) == iso


def test_dates_lead_lines_and_take_years_from_periods(spark):
    assert one(spark, values.find_leading_date, "05/01/2026 TRSF")["iso"] == "2026-01-05"
    assert one(spark, values.find_leading_date, "a long description that ends 05/01/2026") is None
    year = lambda iso, a, b: one(spark, lambda i, s, e: values.resolve_year(i, s, e, F.lit(2026)), iso, a, b)
    assert year("????-01-05", "2026-01-01", "2026-01-31") == year("????-01-05", "2025-12-15", "2026-01-15") == year("2026-01-05", None, None) == "2026-01-05"
    assert tuple(one(spark, values.find_period, "Periode 01/02/2026 s/d 28/02/2026")) == ("2026-02-01", "2026-02-28")
    assert tuple(one(spark, values.find_period, "PERIODE : JANUARI 2026")) == ("2026-01-01", "2026-01-31")
    assert tuple(one(spark, values.find_period, "nothing")) == (None, None)


@pytest.mark.parametrize(
    ("name", "field"),
    [("TGL_TRAN", "date"), ("DESK_TRAN", "description"), ("REMARK_CUSTOM", "remark"), ("GLSIGN", "type"), ("MUTASI_DEBET", "debit"), ("MUTASI_KREDIT", "credit"), ("SALDO_AKHIR_MUTASI", "balance"), *[(n, None) for n in ("SALDO_AWAL_MUTASI", "Opening Balance", "ID", "NOREK", "SEQ", "TRUSER", "KODE_TRAN", "TRREMK", "TLBDS1", "JAM_TRAN", "")]],
)
def test_match_field(spark, name, field):
    assert one(spark, text.match_field, name) == field


def test_payment_fields(spark):
    meta = one(spark, lambda d: text.qris_meta(text.normalize(d)), "QRIS 1234567890123 ID1020012345678 GOPAY WRG MKN BU SRI")
    assert (meta["nmid"], meta["acquirer"], meta["name_hint"]) == ("ID1020012345678", "GOPAY", "WRG MKN BU SRI")
    assert one(spark, lambda d: text.qris_meta(text.normalize(d)), "456042#9360000200122788552 X")["mpan"] == "9360000200122788552"
    assert one(spark, lambda d: text.is_qris(text.normalize(d)), "QRISRNS119003178520") is True
    assert one(spark, lambda d: text.extract_counterparty(text.normalize(d)), "TRSF E-BANKING DB 0302/FTSCY/WS95051 BUDI SANTOSO") == "BUDI SANTOSO"
    assert one(spark, text.dedup_key, "QRIS 12345 Toko Maju") == one(spark, text.dedup_key, "qris 999999 TOKO  MAJU")
    assert one(spark, text.title_case, "BAYAR PLN di PAK budi") == "Bayar PLN DI Pak Budi"
    assert one(spark, text.merge_description, "QRIS ABC", "abc") == "QRIS ABC"
    assert one(spark, text.merge_description, "QRIS 1", "Toko Maju") == "Toko Maju · QRIS 1"


@pytest.mark.parametrize(("said", "bank"), [("Bank Syariah Indonesia", "bsi"), ("BCA flazz", "bca"), ("rekening di BRI", "bri"), ("nothing", "generic")])
def test_detect_bank(spark, said, bank):
    assert one(spark, text.detect_bank, said)["bank"] == bank


def test_number_texts(spark):
    number = lambda f, x: spark.range(1).select(f(F.lit(x).cast("decimal(18,2)")).alias("x")).first()["x"]
    assert number(values.rupiah, "1234567.5") == "Rp\u00a01.234.568"
    assert number(values.rupiah_short, "1250000") == "Rp1,3 jt" or number(values.rupiah_short, "1250000") == "Rp1,2 jt"
    assert number(values.rupiah_short, "-450000") == "-Rp450 rb"
    assert number(values.persen, "0.5") == "50%"


def test_every_merchant_keyword(spark):
    from tallyspark.functions import dims

    assert len(dims.MERCHANTS) == 111 and sum(len(keys) for *_, keys in dims.MERCHANTS) == 364
    want = {k: next(m for m, _, keys in dims.MERCHANTS if any(x in k for x in keys)) for *_, keys in dims.MERCHANTS for k in keys}
    want |= {"BURGER KING": "Burger King", "BLIBLI": "Blibli", "TOKPED": "Tokopedia", "HOKA HOKA": "HokBen", "MARTABAK": "Jajanan", "YOSHINOYA": "Resto Jepang"}
    df = spark.createDataFrame([*want.items()], "n string, want string")
    assert df.filter(~text.match_dictionary(F.col("n"))["merchant"].eqNullSafe(F.col("want"))).count() == 0


def test_a_zero_below_zero_keeps_its_sign(spark):
    x = spark.createDataFrame([(0.0,), (-0.0,), (-1234.5,), (-0.001,)], "x double").select(values.rupiah_precise(F.col("x"))).collect()
    assert [r[0] for r in x] == ["Rp\u00a00,00", "-Rp\u00a00,00", "-Rp\u00a01.234,50", "-Rp\u00a00,00"]
