"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

A tree has orthonormal random directions, one for each level; a node cuts its vectors at the median of their projections, and
knows the mean projection of either side. Directions, cuts and means are fitted on a bounded sample; every vector is indexed.

A query searches all trees through one priority queue. What a query's inner product with a side's mean lacks to that of the
better side is a loss; losses add up along a path, so the leaf of the least loss, of whatever tree, comes next. Leaves are taken
until those that were come to a budget of vectors. The budget is measured, not set: a few queries, chosen by hash, are searched
by brute force, and the budget is what the queue needs to reach the wanted share of their true neighbours. So clustered tables
are searched in a few leaves, and where nothing tells vectors apart a good part of the leaves is, at any size.

Leaves are stored in cells, consecutive leaves of a tree, dealt into blocks of bounded size; a query travels once to each cell that
holds leaves of its own, in blocks too. A block of vectors and a block of queries are multiplied leaf by leaf, and what may be
among a query's best is measured again on the original vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, stored, table

#: Trees, vectors in a leaf on average, levels at most; vectors and bytes of the sample; vectors of the sample in a leaf at least.
TREES, LEAF, DEEPEST, SAMPLE, SAMPLE_BYTES, SPARSE = 4, 128, 16, 1 << 14, 32 << 20, 8
#: Queries that set the budget, and the share of their neighbours that it reaches.
MEASURED, SHARE = 128, 0.95
#: Bytes of vectors and of queries in a block, queries that a task sends to the trees, queries whose best a task keeps; how much of a sum of products rounding may
#: take (relative to the lengths).
BLOCK_BYTES, QUERY_BYTES, SENT, HELD, ROUNDING = 4 << 20, 1 << 20, 256, 1 << 16, 1e-12


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors that are not null, zero, or hold null or non-finite components; of rows that repeat a vec_id the smallest."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.col("vec_id").isNotNull() & F.exists("x", lambda c: c != 0) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(x: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, shorter vectors padded with zeros."""
    out, flat, ends = np.zeros((len(x), dim)), x.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *x.value_lengths().to_pylist()])
    if len(x) and (np.diff(ends) == dim).all():
        return flat.reshape(-1, dim).astype(float)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of rows q with rows x, pair by pair, in an order of summing that depends on nothing else. What
    overflows to both sides counts as the lowest."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((q * x).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


class Forest:
    """Trees fitted on a sample of vectors for a table of n."""

    def __init__(self, sample: np.ndarray, n: int, dim: int, trees: int = TREES):
        self.dim, self.scale = dim, 1.0 / max(float(np.abs(sample).max(initial=0)), np.finfo(float).tiny)
        self.depth = max(0, min(math.ceil(math.log2(max(1, n / LEAF))), int(math.log2(max(1, len(sample) / SPARSE))), DEEPEST))
        rng = np.random.Generator(np.random.PCG64([dim, trees]))
        self.turns, self.cuts, self.means = [], [], []
        for _ in range(trees):
            turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, math.ceil(self.depth / dim)))]
            self.turns.append(np.concatenate(turns, 1)[:, : self.depth])
            at, node, cuts, means = self.projected(sample, self.turns[-1]), np.zeros(len(sample), np.int64), [], []
            for level in range(self.depth):
                order = np.lexsort((at[:, level], node))
                ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
                p = np.append(at[order, level], 0.0)
                cuts.append(p[np.minimum((ends[:-1] + ends[1:]) // 2, len(sample))])
                node = 2 * node + (at[:, level] >= cuts[-1][node])
                count = np.bincount(node, minlength=2 << level)
                mean = np.bincount(node, at[:, level], minlength=2 << level) / np.maximum(1, count)
                means.append(np.where(count > 0, mean, np.repeat(cuts[-1], 2)))
            self.cuts.append(cuts)
            self.means.append(means)
        self.sizes = np.zeros((trees, 1 << self.depth), np.int64)

    def projected(self, x: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return np.clip(x * self.scale, -1e100, 1e100) @ turn

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: a row for each tree."""
        out = np.zeros((len(self.turns), len(x)), np.int64)
        for t, turn in enumerate(self.turns):
            at = self.projected(x, turn)
            for level, cut in enumerate(self.cuts[t]):
                out[t] = 2 * out[t] + (at[:, level] >= cut[out[t]])
        return out

    def search(self, q: np.ndarray, budget: float = math.inf) -> Iterator[tuple[int, int, int]]:
        """(tree, leaf, vectors up to it) in the order of the shared queue, until they are budget vectors."""
        at = [self.projected(q[None, :], turn)[0].tolist() for turn in self.turns]
        queue, seen, gaps, sizes = [(0.0, t, 0, 0) for t in range(len(at))], 0, self.gaps(), self.listed_sizes()
        while queue and seen < budget:
            loss, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                gain = at[t][level] * gaps[t][level][node]  # of the right side over the left
                worse = 2 * node + (gain <= 0)
                heapq.heappush(queue, (loss + abs(gain), t, level + 1, worse))
                level, node = level + 1, worse ^ 1
            seen += sizes[t][node]
            yield t, node, seen

    @cache  # noqa: B019 - a forest lives as long as its task
    def gaps(self) -> list[list[list[float]]]:
        """How far the means of the two sides of each node are apart."""
        return [[(m[1::2] - m[::2]).tolist() for m in means] for means in self.means]

    @cache  # noqa: B019
    def listed_sizes(self) -> list[list[int]]:
        return self.sizes.tolist()

    def cell_bits(self, rows: int) -> int:
        """Levels below a cell: so many leaves that they hold about `rows` vectors."""
        whole = max(1, int(self.sizes[0].sum()))
        return min(self.depth, max(0, int(math.log2(max(1, rows * len(self.sizes[0]) / whole)))))


def _leaf_counts(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        n = np.zeros_like(f.sizes)
        for batch in batches:
            for t, leaf in enumerate(f.leaves(matrix(batch.column(0), f.dim))):
                n[t] += np.bincount(leaf, minlength=n.shape[1])
        t, leaf = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array(n[t, leaf])], ["tree", "leaf", "n"])

    return run


def _nearest(queries, dim: int, k: int):
    """The k nearest of each of a few queries among the rows of the task, and their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat = queries.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64), np.empty((0, dim)))] * len(ids)
        for batch in batches:
            own, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            for i, q in enumerate(mat):
                s = products(q[None, :], x)
                s[own == ids[i]] = -np.inf
                near = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                s, v, y = (np.concatenate(c) for c in zip(best[i], (s[near], own[near], x[near]), strict=True))
                order = np.lexsort((v, -s))[:k]
                best[i] = s[order], v[order], y[order]
        for i, (s, v, y) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(v), pa.array(s), pa.array([r.tobytes() for r in y], pa.binary())], ["query", "vec_id", "score", "x"])

    return run


def _budget(forest: Forest, rows: DataFrame, queries: DataFrame, k: int) -> float:
    """Vectors that the queue takes until SHARE of the true neighbours of MEASURED queries are among them."""
    spark = rows.sparkSession
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).collect()
    mat = np.array([np.r_[r["x"], np.zeros(forest.dim - len(r["x"]))] for r in some])
    ids = np.array([r["vec_id"] for r in some], np.int64)
    near = rows.select("vec_id", "x").mapInArrow(_nearest(spark.sparkContext.broadcast((ids, mat)), forest.dim, k), "query long, vec_id long, score double, x binary")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= k).collect()
    places = []
    for i, q in enumerate(mat):
        own = [np.frombuffer(r["x"]) for r in near if r["query"] == i and r["vec_id"] != ids[i]]
        if not own:
            continue
        leaves, seen = forest.leaves(np.array(own)), {}
        for t, leaf, n in forest.search(q):
            seen[t, leaf] = n
        places += [min(seen[t, leaf] for t, leaf in enumerate(of)) for of in leaves.T.tolist()]
    return float(np.quantile(places, SHARE, method="higher")) if places else 1.0


def _spread(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """One of parts for each id, by hash."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def _indexed(forest, bits: int, rows: int):
    """Vectors to a row for each tree: (tree, cell, part, leaf, vec_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        held = f.sizes.reshape(len(f.sizes), -1, 1 << bits).sum(2)
        parts = np.maximum(1, -(-held // rows))
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), f.dim)
            own = pa.array([r.tobytes() for r in x], pa.binary())
            for t, leaf in enumerate(f.leaves(x)):
                cell = leaf >> bits
                columns = [np.full(len(ids), t, np.int32), cell.astype(np.int32), _spread(ids, parts[t, cell]).astype(np.int32), (leaf & ((1 << bits) - 1)).astype(np.int32), ids]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), own], ["tree", "cell", "part", "leaf", "vec_id", "x"])

    return run


def _visits(forest, bits: int, budget: float):
    """Queries to a row for each cell that they visit: (tree, cell, query_id, leaves: one byte or more a leaf, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            rows = []
            for query_id, q in zip(batch.column(0).to_pylist(), matrix(batch.column(1), f.dim), strict=True):
                cells: dict[tuple[int, int], list[int]] = {}
                for t, leaf, _ in f.search(q, budget):
                    cells.setdefault((t, leaf >> bits), []).append(leaf & ((1 << bits) - 1))
                rows += [(t, c, query_id, np.array(own, np.int32).tobytes()) for (t, c), own in cells.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["tree", "cell", "query_id", "leaves"])

    return run


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A block of a cell's vectors, ordered by leaf."""
    rows = rows.sort_values(["leaf", "vec_id"])
    first = rows.iloc[0]
    return pd.DataFrame({"tree": [first["tree"]], "cell": [first["cell"]], "leaf": [rows["leaf"].to_numpy(np.int32).tobytes()], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "mat": [b"".join(rows["x"])]})


def _pack_queries(dim: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("query_id")
        first, mat = rows.iloc[0], np.array([np.r_[x, np.zeros(dim - len(x))] for x in rows["x"]])
        ends = np.cumsum([0, *(len(v) // 4 for v in rows["leaves"])]).astype(np.int64)
        return pd.DataFrame({"tree": [first["tree"]], "cell": [first["cell"]], "qids": [rows["query_id"].to_numpy(np.int64).tobytes()], "qmat": [mat.tobytes()], "ends": [ends.tobytes()], "leaves": [b"".join(rows["leaves"])]})

    return pack


def _search(dim: int, k: int):
    """Pairs of a block of vectors and a block of queries to (query_id, vec_id, score): the k best of each query in the leaves it
    visits, over all pairs of the task, as long as it holds HELD queries at most; beyond, it gives out what it has and goes on."""

    def pair(row, best: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, leaf, qids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.leaf, np.int32), np.frombuffer(row.qids, np.int64)
        x, q = np.frombuffer(row.mat).reshape(len(ids), dim), np.frombuffer(row.qmat).reshape(len(qids), dim)
        ends, wanted = np.frombuffer(row.ends, np.int64), np.frombuffer(row.leaves, np.int32)
        who = np.repeat(np.arange(len(qids)), np.diff(ends))
        order = np.argsort(wanted, kind="stable")
        who, wanted = who[order], wanted[order]
        size = np.sqrt((q * q).sum(1)) * math.sqrt(float((x * x).sum(1).max(initial=0))) * ROUNDING
        least = np.array([old[0][-1] if (old := best.get(i)) is not None and len(old[0]) == k else -np.inf for i in qids.tolist()])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in np.unique(leaf):
            a, b = np.searchsorted(leaf, [at, at + 1])
            own = who[np.searchsorted(wanted, at) : np.searchsorted(wanted, at + 1)]
            if not len(own):
                continue
            rough = np.nan_to_num(q[own] @ x[a:b].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            rough[qids[own][:, None] == ids[None, a:b]] = -np.inf
            if b - a > k:
                kth = np.partition(rough, b - a - k, 1)[:, b - a - k]
                least[own] = np.maximum(least[own], kth)
            i, j = np.nonzero((rough >= (least[own] - np.nan_to_num(size[own]))[:, None]) & (qids[own][:, None] != ids[None, a:b]))
            out.append((own[i], a + j, rough[i, j]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        i, j, rough = (np.concatenate(c) for c in zip(*out, strict=True))
        near = rough >= least[i] - np.nan_to_num(size[i])
        i, j = i[near], j[near]
        s = np.concatenate([products(q[i[c : c + 65536]], x[j[c : c + 65536]]) for c in range(0, max(1, len(i)), 65536)])
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        own = np.arange(len(i)) - np.searchsorted(i, i) < k
        return qids[i[own]], ids[j[own]], s[own]

    def given(best: dict) -> pd.DataFrame:
        sizes = [len(s) for s, _ in best.values()]
        s, v = (np.concatenate([x[i] for x in best.values()]) if best else np.empty(0) for i in (0, 1))
        return pd.DataFrame({"query_id": np.repeat(np.array([*best], np.int64), sizes), "vec_id": v.astype(np.int64), "score": s.astype(float)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.itertuples():
                with np.errstate(over="ignore", invalid="ignore"):
                    q, v, s = pair(row, best)
                ends = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]) if len(q) else []
                for a, b in zip(ends, ends[1:]):
                    old = best.get(int(q[a]))
                    if old is None:
                        best[int(q[a])] = s[a:b], v[a:b]
                        continue
                    x, y = np.r_[old[0], s[a:b]], np.r_[old[1], v[a:b]]
                    order = np.lexsort((y, -x))
                    x, y = x[order], y[order]
                    new = np.r_[True, y[1:] != y[:-1]]  # another tree may have found a vector before, with the same score
                    best[int(q[a])] = x[new][:k], y[new][:k]
                if len(best) > HELD:
                    yield given(best)
                    best.clear()
        yield given(best)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, trees: int = TREES) -> DataFrame:
    """queries and vectors(vec_id, embedding): the k nearest found of each query by inner product in double precision, its own
    vec_id left out: query_id, rank, vec_id, score.

    Approximate: about SHARE of the true k are found (tests ask for 0.9). Scores are exact, and so is the order of what is found,
    ties to the smaller vec_id. Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do
    rows without vec_id; shorter ones count as padded with zeros. Rows that repeat a vec_id count once, with the smallest vector.
    Of equal vectors only the k + 1 of smallest vec_id can be among anyone's best, so no more of them are indexed. Fewer than k
    vectors: those there are. Empty tables give an empty result; other columns are ignored. Inner products beyond the doubles
    are infinite."""
    spark = vectors.sparkSession
    equal = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    rows = stored(usable(vectors).withColumn("_same", equal).filter(F.col("_same") <= k + 1).select("vec_id", "x"), "vectors")
    queries = stored(usable(queries), "queries")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    n_q, dim_q = queries.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    dim = max(dim, dim_q)
    if not n or not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = [r["x"] for r in rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(size).select("x").collect()]
    forest = Forest(np.array([np.r_[x, np.zeros(dim - len(x))] for x in sample]), n, dim, trees)
    counted = rows.select("x").mapInArrow(_leaf_counts(spark.sparkContext.broadcast(forest)), "tree long, leaf long, n long")
    for r in counted.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # a row for each leaf
        forest.sizes[r["tree"], r["leaf"]] = r["n"]
    budget = _budget(forest, rows, queries, k)
    held = max(LEAF, BLOCK_BYTES // (8 * dim))
    bits, shared, at_once = forest.cell_bits(held), spark.sparkContext.broadcast(forest), max(64, QUERY_BYTES // (8 * dim))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = rows.mapInArrow(_indexed(shared, bits, held), "tree int, cell int, part int, leaf int, vec_id long, x binary")
    index = stored(index.groupBy("tree", "cell", "part").applyInPandas(_pack, "tree int, cell int, leaf binary, ids binary, mat binary"), "index")
    visits = stored(queries.repartition(math.ceil(n_q / SENT), "vec_id").mapInArrow(_visits(shared, bits, budget), "tree int, cell int, query_id long, leaves binary"), "visits")
    full = visits.groupBy("tree", "cell").agg(F.ceil(F.count("*") / at_once).cast("int").alias("parts"))  # a row for each cell at most
    dealt = visits.join(F.broadcast(full), ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int"))
    dealt = dealt.join(queries.withColumnsRenamed({"vec_id": "query_id"}), "query_id")
    blocks = dealt.groupBy("tree", "cell", "part").applyInPandas(_pack_queries(dim), "tree int, cell int, qids binary, qmat binary, ends binary, leaves binary")
    found = index.repartition(tasks, "tree", "cell").join(blocks.repartition(tasks, "tree", "cell"), ["tree", "cell"]).mapInPandas(_search(dim, k), "query_id long, vec_id long, score double")
    # a vector that several trees find has one score: it is one rank
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("query_id", "rank").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
    best = stored(best, "nearest")
    discard(rows, queries, index, visits)
    return best


def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of all embeddings for each whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.filter(F.col("vec_id") % 20 == 0), vectors, 20)
