"""A second ledger, from lineitem and part: seven years of payments of each supplier's account, by merchants of the whole dictionary.

Each part that an account ships in an order line is a row. Its description is one of nine forms by the part, with the part's name and
a keyword of the merchant dictionary; what was returned is money received."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import dims
from tallyspark.functions.values import listed

# Forms of a description. %K: a keyword of the dictionary, %N: the part's name, %R: a reference number.
FORMS = ["QRIS %R ID1020012345678 %K", "PEMBAYARAN %K %R", "TRSF E-BANKING DB 0302/FTSCY/WS95051 %N", "BIAYA %N", "TAGIHAN %K %R", "%K %N", "TOP UP %K %R", "DEBIT CARD %K", "%N %R"]
KEYWORDS = [k for _, _, keys in dims.MERCHANTS for k in keys]
MONEY = "decimal(18,2)"
#: The last digit of an order's number from which a row also stands in the file of the next year.
TWICE = 8


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, seq, date, description, amount, direction; seq is unique within an account."""
    lines, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    # what min(l_returnflag) = 'R' says, by a number: a group's least string would have its rows sorted, on both sides of the shuffle
    flag = F.col("l_returnflag")
    least = F.min(F.when(flag < "R", 0).when(flag == "R", 1).otherwise(2)).alias("flag")
    one = lines.groupBy(F.col("l_suppkey").alias("account_id"), "l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_shipdate").cast("date").alias("date"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("amount"), least)
    named = parts.select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("name"))
    rows = one.join(named.hint("shuffle_hash"), "l_partkey")
    form, word = F.get(listed(FORMS), (F.col("l_partkey") % len(FORMS)).cast("int")), F.get(listed(KEYWORDS), (F.expr(f"l_partkey div {len(FORMS)}") % len(KEYWORDS)).cast("int"))
    number = (F.lit(1234567890000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    said = F.replace(F.replace(F.replace(form, F.lit("%K"), word), F.lit("%N"), F.col("name")), F.lit("%R"), number)
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")
    return rows.select("account_id", seq.alias("seq"), "date", said.alias("description"), "amount", F.when(F.col("flag") == 1, "credit").otherwise("debit").alias("direction"))


def yearly(rows: DataFrame) -> DataFrame:
    """Ledger rows with file_idx and file_name, a file for each year; some rows of a year stand in the next one's file too."""
    year = F.year("date")
    both = F.when(F.expr("seq div 100000000 % 10") >= TWICE, F.array(year, year + 1)).otherwise(F.array(year))
    return rows.withColumn("file_idx", F.explode(both)).withColumn("file_name", F.concat(F.lit("tahun"), F.col("file_idx"), F.lit(".csv"))).withColumn("balance", F.lit(None).cast(MONEY))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same rows for DuckDB, as CTEs led and years.
SQL = f"""
li AS (SELECT l_suppkey AS account_id, l_orderkey, l_linenumber, l_partkey, CAST(min(l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
led AS (SELECT account_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq, date, replace(replace(replace({_list(FORMS)}[l_partkey % {len(FORMS)} + 1], '%K', {_list(KEYWORDS)}[l_partkey // {len(FORMS)} % {len(KEYWORDS)} + 1]), '%N', upper(p_name)), '%R', CAST(1234567890000 + l_orderkey * 10 + l_linenumber AS VARCHAR)) AS description,
  amount, CASE WHEN flag = 'R' THEN 'credit' ELSE 'debit' END AS direction FROM li JOIN part ON l_partkey = p_partkey),
years AS (SELECT led.*, CAST(year(date) + d AS INTEGER) AS file_idx FROM led, (VALUES (0), (1)) v(d) WHERE d = 0 OR seq // 100000000 % 10 >= {TWICE})"""
