"""Line deduplication over whole texts: keys that many documents hold lose their lines everywhere but in one document.

Lines become 128-bit hashes of their keys. The hashes are dealt by range, each range sorted by hash, document and position,
and a streaming window marks the first occurrence of a hash in a document and counts documents on the way. What comes back
to a document is no text but a bitmap of its lines (one bit a line, set: dropped, packed in 64-bit words; words without any
set bit are left out).

A line that a third of all documents hold would put a third of all rows into one range, so the ranges are of (hash, part),
where part deals the documents over PARTS; the parts' counts are summed in a second step, whose rows are one per hash and
part at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACES, ascii_lower, hash128, stored, table

#: Code points that a key has at least, documents that hold it at least, and parts that the documents of a hash are dealt over.
LEAST_LENGTH, LEAST_DOCS, PARTS = 40, 5, 64
BITS = 64


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """docs(doc_id, text) to (h1, h2, part, doc_id, pos): each line whose key has at least so many code points."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.length("line") >= least_length).select("doc_id", "pos", line_key(F.col("line")).alias("key"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")
    return lines.filter(F.length("key") >= least_length).select(*hash128(F.col("key")), part, "doc_id", "pos")


def dropped_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, pos) of the lines to drop: their key is in at least least_docs documents, and this is not the largest of them."""
    occ = stored(occurrences(docs, least_length).withColumn("doc_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))), "lines")
    ranged = occ.repartitionByRange("h1", "part")
    stream = Window.partitionBy("h1", "part").orderBy("h2", "doc_id", "pos")
    same = (F.lag("h2").over(stream) == F.col("h2")) & (F.lag("doc_id").over(stream) == F.col("doc_id"))
    firsts = ranged.withColumn("first", F.when(same, 0).otherwise(1))
    held = firsts.groupBy("h1", "h2", "part").agg(F.sum("first").alias("n"), F.max("doc_id").alias("last"))
    whole = held.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("keeper"), F.collect_set("part").alias("parts"))
    frequent = whole.filter(F.col("n") >= least_docs).select("h1", "h2", "keeper", F.explode("parts").alias("part"))
    hit = occ.join(frequent, ["h1", "h2", "part"]).filter(F.col("doc_id") != F.col("keeper"))
    return hit.select("doc_id", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, pos) of dropped lines to one row a document: doc_id, words (array of struct word, bits; bits set: dropped).

    Words without a dropped line are left out: no row, no word, all lines stay."""
    words = dropped.groupBy("doc_id", F.expr(f"pos div {BITS}").cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pos % {BITS} as int))")).alias("bits"))
    return words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def line_dedup(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs(doc_id, text, ...) with columns _n_lines, _n_dropped and _kept added: lines before, lines dropped, the rest joined by a line feed.

    Null and empty texts are one empty line. Rows that repeat a doc_id are one document when documents are counted, and
    lines at a position that is dropped in one of them are dropped in each (repeats have the same text). A null doc_id counts
    as the smallest. Columns of docs stay as they are, whatever their names; ones named like the added are replaced."""
    docs = docs.drop("_n_lines", "_n_dropped", "_kept")
    bitmaps = keep_bitmaps(dropped_lines(docs, least_length, least_docs)).withColumnsRenamed({"doc_id": "key"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "text")
    rows = rows.join(bitmaps, "key", "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    set_bits = lambda w: F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.bit_get(w["bits"], b) == 1)
    gone = F.flatten(F.transform("words", lambda w: F.transform(set_bits(w), lambda b: w["word"] * BITS + b)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    n = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w["bits"]))
    rows = rows.withColumn("lines", F.when(F.col("words").isNotNull(), lines))
    kept = F.when(F.col("words").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return rows.select("row.*", n_lines.cast("long").alias("_n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("_n_dropped"), kept.alias("_kept"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents before dropping, lines dropped, and the digest of the text that stays."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


def kept_sql(docs: str) -> str:
    """CTEs of DuckDB SQL: deduped(doc_id, n_lines, n_dropped, kept) of a table docs(doc_id, text)."""
    letters = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    strip = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
    return f"""
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
ky AS (SELECT doc_id, pos, line, {letters.format(strip)} AS k FROM ln),
fr AS (SELECT k, max(doc_id) AS keeper FROM ky WHERE length(k) >= {LEAST_LENGTH} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
mk AS (SELECT ky.*, fr.k IS NOT NULL AND doc_id <> keeper AS gone FROM ky LEFT JOIN fr ON ky.k = fr.k),
deduped AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM mk GROUP BY doc_id)"""


SQL = f"WITH {kept_sql('documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
