"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in blocks: rows are packed into blocks of bounded size, and a task multiplies one
block of queries with one block of rows. Scores are never kept. Each pass counts, for each query, the scores that fall into
equal bins of the range in which its k-th largest must lie, sums the counts over blocks and narrows the range to the one bin
that holds the k-th; after a few passes the range is one integer. A last pass emits the scores from there up; ties go to the
smaller id.

A block needs to report only its bins from the top down to its own k-th score: the k-th of all is never lower. So counts and
results grow with queries times blocks times k, not with queries times rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, table

#: Rows and queries in a block, bins of a histogram, bytes of queries that go to the row blocks at once.
ROWS, QUERIES, BINS, SENT = 4096, 1024, 256, 64 << 20
#: Scores that a long cannot hold stop here.
MOST = (1 << 63) - 2


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vectors(vec_id, embedding) to (vec_id, q array of long): floor(scale * x) of each component as double.

    Null vectors and ones that hold null or non-finite components go, as do rows without vec_id. Components that leave 62 bits
    stop there."""
    most = float(1 << 62)
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * scale))).cast("long"))
    fine = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine).select("vec_id", x.alias("q"))


def _pack(block: str, dim: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        mat = np.zeros((len(rows), dim), np.int64)
        for i, v in enumerate(rows["q"]):
            mat[i, : len(v)] = v
        ids = rows["vec_id"].to_numpy(np.int64)
        order = np.lexsort((*mat.T[::-1], ids))  # repeated ids: the smallest vector counts
        ids, mat = ids[order], mat[order]
        once = np.r_[True, ids[1:] != ids[:-1]]
        ids, mat, order = ids[once], mat[once], order[once]
        out = {block: [rows[block].iloc[0]], "ids": [ids.tobytes()], "mat": [mat.tobytes()], "norm": [float(np.sqrt((mat.astype(float) ** 2).sum(1).max(initial=0)))]}
        for c in ("lo", "hi", "need"):
            if c in rows:
                out[c] = [rows[c].to_numpy(np.int64)[order].tobytes()]
        return pd.DataFrame(out)

    return pack


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles or 64-bit integers where no sum can leave these, else by integers of any length.
    What a long cannot hold stops at its ends."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -MOST, MOST).astype(np.int64)


def _blocks(row, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, row ids, their scores, and the queries' lo, hi and need; a query's own row scores below all others."""
    qids, ids = np.frombuffer(row.qids, np.int64), np.frombuffer(row.ids, np.int64)
    s = _scores(np.frombuffer(row.qmat, np.int64).reshape(len(qids), dim), np.frombuffer(row.mat, np.int64).reshape(len(ids), dim))
    s[qids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    return qids, ids, s, *(np.frombuffer(x, np.int64) for x in (row.lo, row.hi, row.need))


def _count(dim: int, bins: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                qids, _, s, lo, hi, need = _blocks(row, dim)
                span = hi.astype(np.uint64) - lo.astype(np.uint64)  # modulo 2**64: ranges may be longer than a signed long
                width = np.maximum(np.uint64(1), span // np.uint64(bins) + (span % np.uint64(bins) > 0))
                inside = (s >= lo[:, None]) & (s < hi[:, None])
                q, at = np.nonzero(inside)
                b = ((s[q, at].astype(np.uint64) - lo[q].astype(np.uint64)) // width[q]).astype(np.int64)
                n = np.bincount(q * bins + b, minlength=len(qids) * bins).reshape(len(qids), bins)
                above = n[:, ::-1].cumsum(1)[:, ::-1] - n
                q, b = np.nonzero((n > 0) & (above < need[:, None]))
                yield pd.DataFrame({"query_id": qids[q], "bin": b.astype(np.int64), "n": n[q, b].astype(np.int64)})

    return count


def _take(dim: int, k: int):
    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                qids, ids, s, lo, *_ = _blocks(row, dim)
                q, at = np.nonzero((s >= lo[:, None]) & (s > np.iinfo(np.int64).min))
                score = s[q, at]
                order = np.lexsort((ids[at], -score, q))
                q, at, score = q[order], at[order], score[order]
                own = np.arange(len(q)) - np.searchsorted(q, q)
                q, at, score = q[own < k], at[own < k], score[own < k]
                yield pd.DataFrame({"query_id": qids[q], "vec_id": ids[at], "score": score})

    return take


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, scale: int = 64, bins: int = BINS) -> DataFrame:
    """queries and rows(vec_id, embedding): each query's k highest scores among all rows but its own: query_id, rank, vec_id, score.

    Shorter vectors count as padded with zeros. Rows that repeat a vec_id count once, with the smallest vector. Fewer than k
    rows: all of them. Empty tables: an empty result. Scores are exact; only those that a long cannot hold stop at its ends (MOST),
    and components at 62 bits. Rows without vec_id take no part. Other columns are ignored.

    Row blocks are written once and stay where they are read; the queries' blocks go to them, in batches of at most SENT bytes."""
    rows, queries = stored(quantised(rows, scale), "rows"), quantised(queries, scale)
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    n_q, dim_q = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    dim, row_blocks, query_blocks = max(dim, dim_q, 1), max(1, math.ceil(n / ROWS)), max(1, math.ceil(n_q / QUERIES))
    packed = rows.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int"))
    packed = packed.repartition(min(row_blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cb").groupBy("cb").applyInPandas(_pack("cb", dim), "cb int, ids binary, mat binary, norm double")
    packed = stored(packed.withColumn("all", F.lit(0)), "blocks")
    longest = packed.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0]
    queries = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    top = F.when(norm * longest * (1 + 1e-9) + 2 < float(1 << 62), F.ceil(norm * longest * (1 + 1e-9)).cast("long") + 1).otherwise(F.lit(MOST))
    state = stored(queries.select("vec_id", "q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), (-top).cast("long").alias("lo"), (top + 1).cast("long").alias("hi"), F.lit(k).cast("long").alias("need")), "state")
    wide = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")
    widest = int(state.agg(F.coalesce(F.max(wide), F.lit(0))).first()[0])
    at_once = max(1, SENT // (QUERIES * dim * 8))

    def scored(state: DataFrame, run, schema: str) -> DataFrame:
        """run over every block of rows with every block of queries, a batch of query blocks at a time."""
        q = state.groupBy("qb").applyInPandas(_pack("qb", dim), "qb int, ids binary, mat binary, norm double, lo binary, hi binary, need binary")
        q = stored(q.select("qb", F.col("ids").alias("qids"), F.col("mat").alias("qmat"), "lo", "hi", "need", F.lit(0).alias("all")), "queries")
        parts = [packed.join(F.broadcast(q.filter(F.expr(f"qb div {at_once}") == i)), "all").mapInPandas(run, schema) for i in range(math.ceil(query_blocks / at_once))]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    while widest > 1:
        counts = scored(state, _count(dim, bins), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        counts = counts.withColumn("above", F.sum("n").over(down) - F.col("n"))
        found = state.join(counts, state["vec_id"] == counts["query_id"]).filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
        wide = "(cast(hi as decimal(20,0)) - cast(lo as decimal(20,0)))"
        width = F.greatest(F.lit(1).cast("long"), F.expr(f"({wide} + {bins - 1}) div {bins}")).cast("decimal(20,0)")
        low = (F.col("lo").cast("decimal(20,0)") + F.col("bin").cast("decimal(5,0)") * width).cast("decimal(20,0)")
        narrow = found.select("vec_id", low.cast("long").alias("lo2"), F.least(F.col("hi").cast("decimal(20,0)"), (low + width).cast("decimal(20,0)")).cast("long").alias("hi2"), (F.col("need") - F.col("above")).alias("need2"))
        # a query that has fewer than k rows finds no bin: it keeps its low end and takes all
        one = F.col("lo2").isNull()
        state = state.join(narrow, "vec_id", "left").select("vec_id", "q", "qb", F.coalesce("lo2", "lo").alias("lo"), F.when(one, F.col("lo")).otherwise(F.col("hi2")).alias("hi"), F.when(one, F.lit(0)).otherwise(F.col("need2")).cast("long").alias("need"))
        state = stored(state, "state")
        widest = -(-widest // bins)
    best = scored(state, _take(dim, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for each whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.filter(F.col("vec_id") % 20 == 0), vectors, 20)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
