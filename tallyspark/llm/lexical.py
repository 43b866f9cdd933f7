"""Ranked lexical search as a blocked sparse matrix product.

The scores of all items against all documents are the product of two sparse matrices: how often an item holds a term, and what
a term counts in a document (its impact, an integer). The second is written once as blocks of documents, each a list of its
terms' postings; a block never leaves the task that reads it. The items come to the blocks: they are the small side, dealt into
batches of bounded size, and a task multiplies its blocks with a batch row by row (Gustavson): the postings of an item's terms,
times their multiplicity, are merged into one row of scores. A task keeps the best of each item over all of its blocks, so what
is shuffled is a few rows for each item and task, whatever the documents number; these meet in two steps.

Only terms that an item holds have postings. Counts over the corpus (documents, terms, the documents of each term) are sums that
each block carries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, stored, table

#: Bytes of items' texts in a batch; documents and postings in a block; bytes of a text that are split at once; tasks whose answers meet first.
BATCH, DOCS, POSTINGS, PART, MET = 64 << 20, 1 << 14, 1 << 20, 1 << 20, 256
#: Letters of a term, as bytes: digits, letters and all that is not ASCII; A-Z lowered, everything else a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> Counter:
    """The terms of a whole text and how often each occurs; long texts go in parts, cut between terms."""
    data, out, at = (text or "").encode("utf-8", "surrogatepass").translate(_TERM), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PART) if at + PART < len(data) else -1
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def _blocks(vocabulary):
    """Documents (doc_id, text) to blocks. Documents without an id count, but have no place in ids: they stand behind the others."""
    names = ["n_docs", "n_terms", "ids", "sizes", "terms", "df", "docs", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, postings, n_docs, n_terms = vocabulary.value, [], 0, 0, 0

        def block() -> pa.RecordBatch:
            held.sort(key=lambda d: d[0] is None)
            ids = np.array([d[0] for d in held if d[0] is not None], np.int64)
            doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(d[2]) for d in held])
            term, tf = (np.fromiter((x[i] for d in held for x in d[2]), np.int64, postings) for i in (0, 1))
            order = np.argsort(term, kind="stable")
            found, df = np.unique(term, return_counts=True)
            values = [[n_docs], [n_terms], [ids.tobytes()], [np.array([d[1] for d in held], np.int64).tobytes()], [found.astype(np.int32)], [df.astype(np.int64)], [doc[order].tobytes()], [tf[order].tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = terms(text.as_py())
                if not own:
                    continue
                n = own.total()
                n_docs, n_terms = n_docs + 1, n_terms + n
                if known := [(number[t], c) for t, c in own.items() if t in number]:
                    held.append((doc_id, n, known))
                    postings += len(known)
                if len(held) >= DOCS or postings >= POSTINGS:
                    yield block()
                    held, postings, n_docs, n_terms = [], 0, 0, 0
        if n_docs:
            yield block()

    return run


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        ids, score = ids[score >= least], score[score >= least]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def _products(items, weights, n_docs: int, n_terms: int, k: int):
    """Blocks to (item, doc_id, score): the best of each item in the blocks of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = items.value, weights.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, size = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
                found, df = np.array(row["terms"], np.int64), np.array(row["df"], np.int64)
                doc, tf = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tf"], np.int64)
                m = 25 + 75 * size * n_docs // n_terms
                impact = np.repeat(weight[found], df) * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                ends = np.r_[0, np.cumsum(df)]
                place = dict(zip(found.tolist(), range(len(found)), strict=True))
                for i, (own, often) in enumerate(rows):
                    score = np.zeros(len(size), np.int64)
                    for t, c in zip(own, often, strict=True):
                        if (at := place.get(t)) is not None:  # a term has one posting for each document at most
                            a, b = ends[at], ends[at + 1]
                            score[doc[a:b]] += c * impact[a:b]
                    score = score[: len(ids)]
                    old = best.get(i)
                    least = int(old[1][-1]) if old is not None and len(old[1]) == k else 1
                    at = np.flatnonzero(score >= least)
                    if len(at):
                        new = (ids[at], score[at]) if old is None else (np.r_[old[0], ids[at]], np.r_[old[1], score[at]])
                        best[i] = _best(*new, k)
        for i, (found, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), pa.array(found), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "doc_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """items(item_id, text) and docs(doc_id, text): each item's k best documents of score above 0: item_id, rank, doc_id, score.

    Terms are runs of digits, letters and signs beyond ASCII in whole texts, A-Z lowered. A term's weight falls with the
    documents that hold it; what it adds to a document's score rises with its occurrences there and falls with the document's
    length against the mean. All is integer arithmetic but for the logarithm in the weight.

    Rows that repeat an item_id are one item, the terms of all; rows that repeat a doc_id are documents of their own, each with a
    rank. Documents without an id count in all statistics and are no answers; items without an id, without terms or without any
    document that shares a term have no rows. Null and empty texts have no terms. Empty tables give an empty result; other columns
    are ignored. Items are read in batches of BATCH bytes: the documents are split into terms once for each batch."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.filter(F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BATCH))
    batch = F.pmod(F.xxhash64("item_id"), F.lit(n))
    parts = [_batch(spark, items.filter(batch == b) if n > 1 else items, docs, k) for b in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _batch(spark: SparkSession, items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """search() for items whose texts fit into BATCH bytes."""
    each: dict = {}
    for item_id, text in items.collect():  # of bounded size: the batch
        each.setdefault(item_id, Counter()).update(terms(text))
    names = sorted({t for own in each.values() for t in own})
    number = {t: i for i, t in enumerate(names)}
    rows = [([number[t] for t in own], [*own.values()]) for own in each.values()]
    shape = "n_docs long, n_terms long, ids binary, sizes binary, terms array<int>, df array<long>, docs binary, tf binary"
    blocks = stored(docs.mapInArrow(_blocks(spark.sparkContext.broadcast(number)), shape), "blocks")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = blocks.select(F.inline(F.arrays_zip("terms", "df"))).groupBy("terms").agg(F.sum("df").alias("df"))
    weight = np.zeros(max(1, len(names)), np.int64)
    for term, df in held.collect():  # a row for each term of the batch at most
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    run = _products(spark.sparkContext.broadcast(rows), spark.sparkContext.broadcast(weight), n_docs, max(1, n_terms), k)
    found = blocks.mapInArrow(run, "item int, doc_id long, score long").withColumn("of", F.floor(F.spark_partition_id() / MET))
    best = stored(_ranked(_ranked(found, ["item", "of"], k).drop("rank"), ["item"], k), "ranked")
    discard(blocks)
    kind = items.schema["item_id"].dataType
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(each)], f"item int, item_id {kind.simpleString()}")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 10)


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same scores by a join on terms.
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_SPLIT}) AS t FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM l),
m AS (SELECT doc_id, 25 + (75 * n * nd) // nt AS m FROM l, c),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM d, c GROUP BY t),
i AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_SPLIT}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, d.doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN d ON i.t = d.t JOIN w ON w.t = d.t JOIN m ON m.doc_id = d.doc_id GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
