"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction. The directions form product codes: the rotated space is cut into PARTS parts, each with its own
random unit codewords, and a filter is one codeword for each part; there are TURNS such codes, each with its own rotation. In
each code a vector lists the LISTED filters of the largest inner products (its cap is as wide as that takes), so every vector
has lists of the same length, found from few inner products part by part. The number of filters grows with the table while
the codewords grow with its PARTS-th root. Vectors that list a common filter are compared in full.

A pair can share many filters. It counts in the smallest one only, which both vectors' lists tell, so no pair is ever
emitted: a bucket yields for each of its vectors the number of links counted there and the root of its links' component.
Large buckets are dealt over blocks of bounded size and compared block by block. Equal vectors are one before all this.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, table
from tallyspark.llm.graphs import components

#: Parts of a product code and codes; filters that a vector lists in each code, up to so many vectors, and by which power of their number more.
PARTS, TURNS, LISTED, MANY, MORE = 3, 4, 20, 1e4, 0.2
#: Vectors of no relation that list a filter on average; dimensions that fewer ones are turned into.
MET, WIDE = 0.25, 24
#: Vectors in a block of a bucket; buckets up to LITTLE are compared by shifting rows; vectors decoded at once.
BLOCK, LITTLE, DECODED = 1024, 12, 256


def cap_share(t: np.ndarray, dim: int) -> np.ndarray:
    """Share of the unit sphere whose inner product with a direction is at least t."""
    x = np.linspace(-1, 1, 200_001)
    density = np.maximum(0.0, 1 - x * x) ** ((dim - 3) / 2) if dim >= 3 else np.ones_like(x)
    tail = np.cumsum(density[::-1])[::-1]
    return np.interp(t, x, tail / tail[0])


class Code:
    """The product codes for n vectors of a dimension; the same for the same numbers, on every machine."""

    def __init__(self, n: int, dim: int, least: float = 0.9):
        # in few dimensions unrelated vectors link too, so no more filters help than caps of linked vectors fit on the sphere
        n = max(1.0, min(n, 1 / max(float(cap_share(np.array(least), dim)), 1e-300)))
        self.listed = math.ceil(LISTED * max(1.0, n / MANY) ** MORE)
        self.size = max(4, math.ceil((self.listed * n / MET) ** (1 / PARTS)))
        wide = max(dim, WIDE)
        rng = np.random.Generator(np.random.PCG64([dim, PARTS]))
        self.cuts = np.linspace(0, wide, PARTS + 1).astype(int)
        self.turns, self.words = [], []
        for _ in range(TURNS):
            self.turns.append(np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim])
            words = [rng.standard_normal((self.size, b - a)) for a, b in zip(self.cuts, self.cuts[1:])]
            self.words.append([w / np.linalg.norm(w, axis=1, keepdims=True) for w in words])
        # the places, in the order of each part's products, that one of the largest sums can be made of
        self.listed = min(self.listed, self.size**PARTS)
        places = [()]
        for _ in range(PARTS):
            places = [(*p, i) for p in places for i in range(min(self.size, self.listed // math.prod(x + 1 for x in p)))]
        self.places = np.array(places)

    def lists(self, unit: np.ndarray) -> np.ndarray:
        """The sorted numbers of the filters that each unit vector lists; a row for each."""
        out = []
        for t, (turn, words) in enumerate(zip(self.turns, self.words)):
            turned = unit @ turn
            sums, names = np.zeros((len(unit), 1)), np.full((len(unit), 1), t, np.int64)
            for (a, b), w, place in zip(zip(self.cuts, self.cuts[1:]), words, self.places.T):
                product = turned[:, a:b] @ w.T
                order = np.argpartition(-product, min(place.max(), self.size - 1), 1)[:, : place.max() + 1]
                order = np.take_along_axis(order, np.argsort(-np.take_along_axis(product, order, 1), 1), 1)
                sums = sums + np.take_along_axis(product, order, 1)[:, place]
                names = names * self.size + order[:, place]
            best = np.argpartition(-sums, self.listed - 1, 1)[:, : self.listed]
            out.append(np.take_along_axis(names, best, 1))
        return np.sort(np.concatenate(out, 1), 1)


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, shorter vectors padded with zeros."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum([0, *(len(v) for v in vectors)])
    if len(vectors) and len(flat) == len(vectors) * dim and (np.diff(ends) == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(vectors), dim))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that neither tiny nor huge components are lost in the squares."""
    x = x / np.abs(x).max(1, keepdims=True, initial=0).clip(np.nextafter(0, 1))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _decode(n: int, dim: int, least: float):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(n, dim, least)
        for batch in batches:
            for i in range(0, len(batch), DECODED):
                part = batch.slice(i, DECODED)
                unit = normalised(matrix(part.column(1), dim))
                lists = code.lists(unit)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(list(lists), pa.list_(pa.int64()))], ["id", "copies", "unit", "filters"])

    return decode


def _roots(links: np.ndarray) -> np.ndarray:
    """The smallest index that links reach, for each row of a symmetric matrix of links."""
    root = np.arange(len(links))
    while True:
        near = np.minimum(root, np.where(links, root[None, :], len(links)).min(1))
        near = near[near]
        if (near == root).all():
            return root
        root = near


def _earlier(lists: list[np.ndarray], f: int) -> np.ndarray:
    """Which pairs share a filter before f."""
    before = [x[x < f] for x in lists]
    names, at = np.unique(np.concatenate(before), return_inverse=True)
    held = np.zeros((len(lists), max(1, len(names))), np.float32)
    held[np.repeat(np.arange(len(lists)), [len(x) for x in before]), at] = 1
    return held @ held.T > 0


def _compare(least: float):
    """Buckets in order, each whole: (bucket, left, right, side, id, copies, unit, filters) to (id, n, root)."""

    def bucket(f: int, side: np.ndarray, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, lists: list[np.ndarray]):
        links = x @ x.T >= least
        np.fill_diagonal(links, False)
        if side.any():  # two blocks: only pairs across
            links &= side[:, None] != side[None, :]
        busy = np.flatnonzero(links.any(1))
        if not len(busy):
            return
        links = links[np.ix_(busy, busy)]
        new = links & ~_earlier([lists[i] for i in busy], f)
        yield from zip(ids[busy], (new * copies[busy][None, :]).sum(1), ids[busy][_roots(links)], strict=True)

    def little(f: np.ndarray, key: np.ndarray, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, lists: list[np.ndarray]):
        """Many small buckets at once: each row with the rows that follow it in its bucket."""
        for k in range(1, LITTLE):
            near = np.flatnonzero(key[:-k] == key[k:]) if k < len(key) else ()
            if not len(near):
                break
            near = near[np.einsum("ij,ij->i", x[near], x[near + k]) >= least]
            for a, b in zip(near, near + k):
                first = np.intersect1d(lists[a], lists[b], assume_unique=True)[0] == f[a]
                yield ids[a], int(first) * copies[b], min(ids[a], ids[b])
                yield ids[b], int(first) * copies[a], min(ids[a], ids[b])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            a, n, r = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64)) for v in (a, n, r)], ["id", "n", "root"])

        def done(t: pa.Table) -> list:
            f, side, ids, copies = (t[c].to_numpy() for c in ("bucket", "side", "id", "copies"))
            key = np.cumsum(np.r_[0, (f[1:] != f[:-1]) | (t["left"].to_numpy()[1:] != t["left"].to_numpy()[:-1]) | (t["right"].to_numpy()[1:] != t["right"].to_numpy()[:-1])])
            x = np.frombuffer(b"".join(t["unit"].to_pylist()), float).reshape(len(ids), -1)
            lists = [np.frombuffer(v, np.int64) for v in t["filters"].to_pylist()]
            size = np.bincount(key)
            small = size[key] <= LITTLE
            at = np.flatnonzero(small & ~side.astype(bool) & (t["left"].to_numpy() == t["right"].to_numpy()))
            rows = [*little(f[at], key[at], ids[at], copies[at], x[at], [lists[i] for i in at])]
            rest = np.setdiff1d(np.arange(len(ids)), at)
            for k in np.unique(key[rest]):
                i = np.flatnonzero(key == k)
                rows += bucket(f[i[0]], side[i], ids[i], copies[i], x[i], [lists[j] for j in i])
            return rows

        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t])
            key = np.stack([t[c].to_numpy() for c in ("bucket", "left", "right")])
            last = np.flatnonzero((key != key[:, -1:]).any(0)) if len(t) else ()
            cut = int(last[-1]) + 1 if len(last) else 0
            kept = t.slice(cut)
            if cut and (rows := done(t.slice(0, cut).combine_chunks())):
                yield out(rows)
        if kept is not None and len(kept) and (rows := done(kept.combine_chunks())):
            yield out(rows)

    return compare


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vectors(vec_id, embedding) to vec_id, n_links, component_id, kept: links join vectors of cosine at least `least`.

    Found links are confirmed in double precision; one is missed only if the two list no filter in common; of 8000 random
    pairs just at 0.9 in 64 dimensions none was, with the codes for 1000, 51282 and 1000000 vectors. Vectors that are null, zero,
    empty or hold null or non-finite components link with nothing and stay as they are. Shorter vectors count as padded with zeros. Rows of
    equal vectors link with each other; rows that repeat a vec_id are vectors of their own that share a component, and a
    null vec_id takes no part (its row is kept). An empty table gives an empty one; other columns are ignored."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("vec_id").isNotNull() & F.exists("embedding", lambda c: c != 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.coalesce(fine, F.lit(False))
    same = stored(rows.filter(fine).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n, dim = same.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    decoded = same.select("rep", "embedding", "copies").mapInArrow(_decode(n, dim, least), "id long, copies long, unit binary, filters array<long>")
    decoded = stored(decoded, "decoded")
    light = decoded.select("id", F.explode("filters").alias("bucket"))
    counts = light.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    # a filter that one vector alone lists joins no pair: it stays out of the lists that travel
    shared = stored(light.join(counts, "bucket"), "shared")
    light = shared.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    light = light.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    light = light.select("id", "bucket", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    names = shared.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("names"))
    full = decoded.select("id", "copies", "unit").join(names, "id")
    packed = light.join(full, "id").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "id")
    found = stored(packed.mapInArrow(_packed_lists(_compare(least)), "id long, n long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    classes = same.join(links, same["rep"] == links["id"], "left").select("embedding", "rep", "copies", F.coalesce("n", F.lit(0)).alias("n"))
    classes = classes.join(joined, classes["rep"] == joined["id"], "left").select("embedding", (F.col("n") + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    linked = rows.filter(fine).join(classes, "embedding").select("vec_id", "n", "component")
    out = linked.union(rows.filter(~fine).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def _packed_lists(compare):
    """The filter lists of Arrow rows as bytes, the form that compare takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.column(b.schema.get_field_index("names"))
                flat, ends = names.flatten().to_numpy(), np.cumsum([0, *names.value_lengths().to_pylist()])
                cols = [b.column(b.schema.get_field_index(c)) for c in ("bucket", "left", "right", "side", "id", "copies", "unit")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([flat[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())], ["bucket", "left", "right", "side", "id", "copies", "unit", "filters"])

        yield from compare(packed())

    return run


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Links by brute force over all pairs, then the smallest id reachable.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
r AS (SELECT a AS id, b AS c FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
k AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(m.c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.c, vec_id)) AS kept
FROM embeddings LEFT JOIN m ON vec_id = m.id LEFT JOIN k ON vec_id = k.id
"""
