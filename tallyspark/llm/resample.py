"""Importance resampling of documents towards a target distribution of hashed n-grams, by DataFrame functions alone.

Every run of words is hashed into one of BUCKETS buckets. Counts of buckets over the corpus and over target texts give each
bucket a gain: how much likelier the target is to show it. A document weighs what its features gain on average; Gumbel noise
that depends on its id alone makes the highest scores a sample without replacement in proportion to the weights.

The texts are split once: a table of each row's bucket numbers is written, and everything else reads that. Counts and the sums of
documents are aggregated before they are shuffled; the gains are a table of one row a bucket, so it may be broadcast. Ranks come
from one distributed sort: rows are range partitioned and sorted, and a row's rank is its place in its partition plus the rows
of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import ascii_lower, stored, table

#: Words of a feature at most, buckets, words that a document needs to be drawn, percent that are drawn, seed of the noise.
LONGEST, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Words, once A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of monotonically_increasing_id that count the rows of a partition.
PLACES = 33


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def features(words: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words, joined by one space."""
    out = words
    for n in range(2, longest + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        out = F.concat(out, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))  # noqa: B023 - used at once
    return out


def bucketed(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """rows(doc_id, text) to (doc_id, n_words, found: the bucket of each feature)."""
    split = rows.select("doc_id", words_of(F.col("text")).alias("words"))
    bucket = F.transform(features(F.col("words"), longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), bucket.alias("found"))


def counts(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: 1000 times the logarithm of its share of the target over its share of the corpus, each
    with one added to every bucket, rounded down. Its window is over one row a bucket."""
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))
    both = both.withColumns({"all_s": F.sum("s").over(whole), "all_t": F.sum("t").over(whole)})
    d = lambda c, more: (F.col(c) + more).cast("double")
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return both.select("bucket", F.floor(F.log(ratio) * 1000.0).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate of the document's id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def placed(rows: DataFrame) -> DataFrame:
    """rows(score, doc_id, ...) with rank: 1 for the highest score, ties to the smaller doc_id. Range partitions, sorted; the table
    of their sizes has one row for each partition."""
    ordered = rows.repartitionByRange(F.col("score").desc(), F.col("doc_id").asc()).sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc(), *[F.col(c) for c in rows.columns if c not in ("score", "doc_id")])
    ordered = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", PLACES)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    return ordered.join(sizes, part == F.col("_of")).withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << PLACES) - 1) + 1).drop("_at", "_of", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) and target(text) to (doc_id, n_features, weight, score, rank), one row for each of docs.

    weight: mean gain of its features, rounded down (0 without any); score: weight plus noise; rank: 1, 2, 3, ... of the documents
    that are drawn, the highest scores of those with at least `least` words, percent of their number, rounded down; null for
    the others.

    Null and empty texts have no features. A null doc_id has neither score nor rank and counts in all statistics but not among
    those that are drawn from. Rows that repeat a doc_id are documents of their own; with equal scores the shorter comes first, and
    equal rows are interchangeable. Empty tables give an empty result, an empty target leaves corpus counts alone to decide. Other
    columns are ignored. The words of one text fit into a task's memory, as the text does."""
    spark = docs.sparkSession
    found = stored(bucketed(docs.select("doc_id", "text"), longest, buckets).withColumn("row", F.monotonically_increasing_id()), "found")
    aim = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = stored(gains(spark, counts(found, "s"), counts(aim, "t"), buckets), "gains")
    each = found.select("row", "doc_id", "n_words", F.explode_outer("found").alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    # a document's rows are in one task, so that it is one row before the shuffle
    sums = each.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(g - pmod(g, n_features)) div n_features")).cast("long")
    scored = sums.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "scored")
    fits = F.coalesce((F.col("n_words") >= least) & F.col("doc_id").isNotNull(), F.lit(False))
    able = scored.filter(fits).select("doc_id", "score", "n_features", "weight")
    n = able.count()
    ranked = placed(able).withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(names).union(scored.filter(~fits).withColumn("rank", F.lit(None).cast("long")).select(names))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the words of the benchmark texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_RUNS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same rows; the checksum of each different word is taken bit by bit.
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_RUNS}, []) AS ws FROM documents),
e AS MATERIALIZED (SELECT doc_id, unnest(ws) AS f FROM d),
b AS MATERIALIZED (SELECT unnest({_RUNS}) AS f FROM benchmark),
u AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM (SELECT f FROM e UNION ALL SELECT f FROM b)),
y AS (SELECT f, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(CAST(concat('0x', substr(x, 2 * i + 1, 2)) AS INTEGER) AS BIGINT))),
   lambda c, v: list_reduce(list_prepend(xor(c, v), range(8)), lambda r, j: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS c FROM u),
k AS MATERIALIZED (SELECT f, CAST(xor(c, 4294967295) % {BUCKETS} AS BIGINT) AS k FROM y),
s AS (SELECT k, count(*) AS s FROM e JOIN k ON e.f = k.f GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN k ON b.f = k.f GROUP BY k),
n AS (SELECT (SELECT sum(s) FROM s) AS ns, (SELECT sum(t) FROM t) AS nt),
g AS (SELECT s.k, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ns + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(nt + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.k = t.k, n),
m AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS gs FROM e JOIN k ON e.f = k.f JOIN g ON g.k = k.k GROUP BY doc_id),
w AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (gs - ((gs % n_features) + n_features) % n_features) // n_features END AS weight FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
z AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((CAST(CAST(concat('0x', substr(sha256(concat('{SEED}:', doc_id)), 1, 8)) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST} ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN n_features >= {LEAST} AND place <= {PERCENT} * (SELECT count(*) FROM z WHERE n_features >= {LEAST}) // 100 THEN place END AS rank FROM r
"""
