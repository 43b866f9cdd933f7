"""A ledger of bank statements derived from the events table: what the jobs are run on where no statement files are at hand.

Each event becomes a statement row of its user's account: one of sixteen descriptions by event_id, with a fixed amount or one
from the event's value; every third description carries a second row, a fee.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Description (%R: a reference number), direction, amount (None: from the event's value).
TEMPLATES = [
    ("QRIS %R ID1020012345678 WRG MKN BU SRI", "debit", None),
    ("QRIS PAYMENT INDOMARET CIPETE %R", "debit", None),
    ("TRSF E-BANKING DB 0302/FTSCY/WS95051 BUDI SANTOSO", "debit", None),
    ("BIAYA ADM", "debit", 5000),
    ("GAJI PT SUMBER MAKMUR FEB 2026", "credit", 5000000),
    ("PEMBAYARAN TAGIHAN PLN 512345678901", "debit", 350000),
    ("TOP UP GOPAY 081234567890", "debit", 200000),
    ("TARIK TUNAI ATM 1234", "debit", 1000000),
    ("QRIS 1122334455667 NETFLIX COM", "debit", 186000),
    ("BAGI HASIL TABUNGAN", "credit", 12450),
    ("QRIS %R#9360000900000000001", "debit", None),
    ("QRIS %R ID1020099988877 ZZQX PRIMA", "debit", None),
    ("TRANSFER MASUK BIFAST DARI SITI AMINAH", "credit", 750000),
    ("PEMBAYARAN SPOTIFY PREMIUM", "debit", 54990),
    ("QRIS %R APOTEK SEHAT SENTOSA", "debit", None),
    ("QRIS %R GRABFOOD ORDER", "debit", None),
]
FEE_TEMPLATE, FEE, OPENING = 2, 2500, 50_000_000
#: The two files that an account's rows lie in, by last and first day: ten days are in both.
FILE_ENDS, FILE_STARTS = "2024-01-20", "2024-01-11"
MONEY = "decimal(18,2)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, seq, date, description, amount, direction, raw_direction, balance; seq is the order within an account.

    The balance is a running sum per account: an account's rows are one window, as its statements are one document."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    k = F.pmod("event_id", F.lit(len(TEMPLATES)))
    pick = lambda at: F.get(F.array(*[F.lit(t[at]) for t in TEMPLATES]), k.cast("int"))
    fixed = F.get(F.array(*[F.lit(None if t[2] is None else str(t[2])).cast(MONEY) for t in TEMPLATES]), k.cast("int"))
    number = (F.lit(1234567890000) + F.col("event_id")).cast("string")
    main = events.select(
        F.col("user_id").alias("account_id"),
        (F.col("event_id") * 10).alias("seq"),
        F.col("ts").cast("date").alias("date"),
        F.replace(pick(0), F.lit("%R"), number).alias("description"),
        F.coalesce(fixed, F.round(F.col("value") * 1000).cast(MONEY)).alias("amount"),
        pick(1).alias("direction"),
        "event_id",
    )
    is_fee = F.explode(F.when(F.pmod("event_id", F.lit(len(TEMPLATES))) == FEE_TEMPLATE, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("fee")
    rows = main.select("*", is_fee).withColumn("seq", F.col("seq") + F.col("fee")).withColumn("amount", F.when(F.col("fee") == 1, F.lit(FEE).cast(MONEY)).otherwise(F.col("amount")))
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    running = F.sum(signed).over(Window.partitionBy("account_id").orderBy("seq")) + OPENING
    raw = F.when(F.pmod("event_id", F.lit(7)) == 0, "debit").otherwise(F.col("direction"))
    return rows.select("account_id", "seq", "date", "description", "amount", "direction", raw.alias("raw_direction"), running.cast(MONEY).alias("balance"))


def statement_rows(rows: DataFrame) -> DataFrame:
    """Ledger rows with file_idx and file_name: rows of the days that both files cover stand in either."""
    files = F.array_compact(F.array(F.when(F.col("date") <= F.lit(FILE_ENDS).cast("date"), F.lit(0)), F.when(F.col("date") >= F.lit(FILE_STARTS).cast("date"), F.lit(1))))
    return rows.withColumn("file_idx", F.explode(files)).withColumn("file_name", F.concat(F.lit("part"), F.col("file_idx"), F.lit(".csv")))


def _sql_list(at: int) -> str:
    quoted = [("NULL" if t[at] is None else f"'{t[at]}'") for t in TEMPLATES]
    return f"[{', '.join(quoted)}]"


#: The same rows for DuckDB, as CTEs led and files.
SQL = f"""
ev AS (SELECT event_id, user_id, value, CAST(ts AS DATE) AS date, CAST(event_id % 16 AS INTEGER) + 1 AS k FROM events),
main AS (SELECT event_id, user_id AS account_id, event_id * 10 AS seq, date, replace({_sql_list(0)}[k], '%R', CAST(1234567890000 + event_id AS VARCHAR)) AS description,
  CAST(coalesce(CAST({_sql_list(2)}[k] AS DECIMAL(18,2)), CAST(round(value * 1000) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, {_sql_list(1)}[k] AS direction, k FROM ev),
bothr AS (SELECT event_id, account_id, seq, date, description, amount, direction FROM main UNION ALL
  SELECT event_id, account_id, seq + 1, date, description, CAST({FEE} AS DECIMAL(18,2)), direction FROM main WHERE k = {FEE_TEMPLATE + 1}),
led AS (SELECT account_id, seq, date, description, amount, direction, CASE WHEN event_id % 7 = 0 THEN 'debit' ELSE direction END AS raw_direction,
  CAST({OPENING} + sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY account_id ORDER BY seq) AS DECIMAL(18,2)) AS balance FROM bothr),
files AS (SELECT led.*, 0 AS file_idx, 'part0.csv' AS file_name FROM led WHERE date <= DATE '{FILE_ENDS}' UNION ALL SELECT led.*, 1, 'part1.csv' FROM led WHERE date >= DATE '{FILE_STARTS}')"""
