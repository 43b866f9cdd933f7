"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in one fixed order; each adds its expected number of copies to a running sum that
starts at one random offset, and is emitted once for every integer the sum crosses. The order puts documents of like
size together, so that the words taken stay near the target too.

The running sum is cut in two so that no source, however large, meets in one task: sums of small cells (source, size
class, spread) are windows of bounded size, and only the cells' totals are summed along a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, stored, table

#: Weights of the sources in order of their names, repeating; a target is at most this many times its source's size.
WEIGHTS, MOST = (5, 2, 1), 3
#: Expected copies are whole multiples of 1 / UNIT, so that sums are exact in any order.
UNIT = 1 << 24
#: Cells that one size class of a source is spread over.
SPREAD = 256


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size), one row a source, to (source, source_size, target).

    Sources in order of code points, null last, weigh weights[0], weights[1], ... repeating. They share the sum of all
    sizes by weight; no target exceeds most times its source's size, and what is cut off goes to the others by weight until
    none is above. Filling goes by rising ratio of cap to weight: the first k sources are capped, where k is the number of
    sources whose cap lies below their share of what the capped ones before them leave. This table has a row per source, so
    its windows are small whatever the documents number."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    rise = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("rank").asc())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = F.pmod(F.col("rank") - 1, F.lit(len(weights)))
    w = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        w = F.when(kind == i, F.lit(x)).otherwise(w)
    out = sizes.withColumn("rank", F.row_number().over(rank)).withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    out = out.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    out = out.withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # level: words a unit of weight, were this source and all after it uncapped
    out = out.withColumn("level", F.col("left").cast("double") / F.col("w_left").cast("double"))
    out = out.withColumn("capped", F.col("cap").cast("double") <= F.col("level") * F.col("w").cast("double"))
    level = F.min(F.when(~F.col("capped"), F.struct("rise", "level"))).over(whole)
    out = out.withColumn("rise", F.row_number().over(rise)).withColumn("at", level)
    target = F.when(F.col("at").isNull() | (F.col("rise") < F.col("at.rise")), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.col("at.level"))
    return out.select("source", "source_size", target.alias("target"))


def placed(rows: DataFrame, seed: int) -> DataFrame:
    """The cell of each row: its source's size class (sizes alike in their first six binary digits) and a spread by md5 of its id."""
    rows = rows.withColumn("m", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("low", F.greatest(F.length(F.bin("size")) - 6, F.lit(0)))
    rows = rows.withColumn("class", F.expr("cast(shiftright(size, low) as bigint)") + F.col("low") * 1000)
    return rows.withColumn("cell", F.pmod(F.conv(F.substring("m", 1, 4), 16, 10).cast("int"), F.lit(SPREAD))).drop("low")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, size: Column | None = None) -> DataFrame:
    """docs(doc_id, source, ...) with columns _size, _source_size, _target and _copies added: how often the mix takes the document.

    size: a column of docs, by default the word count of its column text. A null text has size 0; a null source is a source
    of its own, the last; repeated rows are documents of their own and interchangeable; of an empty table comes an empty one.
    Extra columns stay, whatever their names; ones named like the added are replaced. Order and offsets come from md5 of
    ids, sources and seed: reruns agree however the rows are dealt."""
    docs = docs.drop("_size", "_source_size", "_target", "_copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    size = (word_count(F.col("text")) if size is None else size).cast("long").alias("size")
    # the sizes are written once: sums over them are taken twice, and counting words is most of the work
    keys = stored(placed(docs.select("doc_id", "source", size), seed), "sizes")
    cells = keys.groupBy("source", "class", "cell").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    aims = targets(cells.groupBy("source").agg(F.sum("s").alias("source_size")), weights, most)
    rate = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")) * UNIT)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("null")))), 1, 6), 16, 10).cast("long")
    aims = aims.select("source", "source_size", "target", F.coalesce(rate, F.lit(0)).cast("long").alias("rate"), start.alias("start"))

    def before(*by: str) -> Column:
        w = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    def with_source(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        right = right.withColumnsRenamed({c: f"r_{c}" for c in ("source", *by)})
        on = [left["source"].eqNullSafe(right["r_source"]), *(left[c] == right[f"r_{c}"] for c in by)]
        return left.join(right, on).drop("r_source", *(f"r_{c}" for c in by))

    # documents before each cell of its source: in the classes before, then in the cells before of its class
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n")).select("source", "class", before("source", "class").alias("base"))
    first = cells.select("source", "class", "cell", before("source", "class", "cell").alias("inner"))
    first = with_source(with_source(first, classes, "class"), aims).withColumn("first", F.col("inner") + F.col("base")).drop("inner", "base")
    rows = placed(docs.select("doc_id", "source", size, row), seed)
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("source", "class", "cell").orderBy("m", "doc_id")))
    out = with_source(rows, first, "class", "cell")
    end = (F.col("first") + F.col("at")) * F.col("rate") + F.col("start")
    bits = UNIT.bit_length() - 1
    copies = F.shiftright(end, bits) - F.shiftright(end - F.col("rate"), bits)
    return out.select("row.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.alias("_copies"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their size, their source's size and target, and the words that the mix takes of them."""
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words")), "words")
    return mix(docs, size=F.col("n_words")).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


#: The same rows by DuckDB, over a table or subquery d(doc_id, source, size) that the text before it names.
MIX_SQL = f"""
p AS (SELECT *, md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS m, greatest(length(bin(size)) - 6, 0) AS low FROM d),
k AS (SELECT *, (size >> low) + 1000 * low AS class, CAST(concat('0x', substr(m, 1, 4)) AS BIGINT) % {SPREAD} AS cell FROM p),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w, source_size * {MOST} AS cap FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, rnk) AS rise FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY rise ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY rise ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM o),
a AS (SELECT min(rise) AS at_rise, arg_min(level, rise) AS at_level FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, CASE WHEN at_rise IS NULL OR rise < at_rise THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * at_level END AS target FROM l, a),
q AS (SELECT *, CAST(coalesce(floor(target / CAST(nullif(source_size, 0) AS DOUBLE) * {UNIT}), 0) AS BIGINT) AS rate,
        CAST(concat('0x', substr(md5(concat('0:', coalesce(source, 'null'))), 1, 6)) AS BIGINT) AS start FROM t),
n AS (SELECT k.*, row_number() OVER (PARTITION BY source ORDER BY class, cell, m, doc_id) AS pos FROM k),
mixed AS (SELECT n.*, source_size, target, ((pos * rate + start) >> {UNIT.bit_length() - 1}) - ((pos * rate + start - rate) >> {UNIT.bit_length() - 1}) AS copies FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source)"""

SQL = f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),{MIX_SQL}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"""
