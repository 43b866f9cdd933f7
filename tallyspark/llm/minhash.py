"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents of the same set are one class, found by a digest of the set before anything else; the forest holds one member of
each class. A signature is a ring of minima; tree t sorts the members, across the cluster by range partitions, by the ring
read from its own place on, and each member is compared with its neighbour in that order by their longest common prefix.
A run of neighbours that share DEPTH minima is a region: candidates of each other. Where it is sparse, neighbours that share
no more than LEAST minima are candidates too, pair by pair.

Regions form clusters (components of "in one region"). A cluster of at most SMALL members is settled in one place: every
pair that is not yet connected is compared on full sets, so no link is lost there. In a larger cluster the regions are cut
deeper as far as they are dense, each to the depth that leaves it at most REGION members, and a region is settled in one
place, all its pairs at once. What is settled in one place also holds at most about LOAD shingles, be they many or few members'. The trees come in turns: a turn skips the regions whose members confirmed links connect already.
A region that is dense at every depth (its members agree on DEEPEST minima in a row, so they are all but equal) is settled in
parts that their smallest members tie together. All this only connects the most of a dense region cheaply: what it leaves
apart is then compared at DEPTH, whole, each part of the region with each other one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, table
from tallyspark.llm.graphs import components
from tallyspark.llm.shingles import WORDS, shingle_sets

#: Trees, minima by which one tree's place on the ring differs from the next one's, minima of neighbours in sparse parts, least
#: and greatest depth of a region; rows that a range of the sorted orders has.
TREES, STRIDE, LEAST, DEPTH, DEEPEST, RANGE = 16, 5, 3, 5, 8, 1 << 20
#: Members of a cluster that is settled in one place, members of a region that is settled in one place, trees in each turn.
SMALL, REGION, TURNS = 64, 1024, ((0, 1), (2, 5), (6, 15))
#: Shingles of all members of what is settled in one place, and bytes of sets that a task gives out at once.
LOAD, GIVEN = 1 << 21, 8 << 20
#: Shingles that the intersections of a region are counted over at once.
COLUMNS = 4096
#: Links by percent of the union, as exact integers.
PERCENT = 80

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 1 << 63, TREES * STRIDE, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 64, TREES * STRIDE, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of TREES * STRIDE 32-bit minima for each set; none of the sets is empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(_A)), ">u4")
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        out[:, i] = np.minimum.reduceat(((flat ^ b) * a) >> np.uint64(32), at)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_key", "signature"]
    for batch in batches:
        ids, sizes, keys, sigs, group = [], [], [], [], []

        def flush() -> None:
            full = [s for s in group if len(s)]  # noqa: B023
            rows = iter(signatures(full)) if full else iter(())
            sigs.extend(next(rows).tobytes() if len(s) else None for s in group)  # noqa: B023
            group.clear()  # noqa: B023

        held = 0
        for one in shingle_sets(batch.column(1)):
            sizes.append(len(one))
            keys.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None)
            group.append(one)
            held += len(one)
            if held > 1 << 17:
                flush()
                held = 0
        flush()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, held, at = [], 0, 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.binary())], ["id", "shingles"])  # noqa: B023 - used at once

        for one in shingle_sets(batch.column(1)):
            sets.append(one.tobytes())
            held += one.nbytes
            if held > GIVEN:
                yield given()
                at, sets, held = at + len(sets), [], 0
        yield given()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct values."""
    few, many = min(len(a), len(b)), max(len(a), len(b))
    if 100 * few < percent * many:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def all_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A matrix of all links among sets, from the exact sizes of all intersections; values in one set only cannot add to these."""
    sizes = np.array([len(s) for s in sets], float)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(count > 1) - 1
    row, at = row[count[at] > 1], column[at[count[at] > 1]]
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[a:b], at[a:b] - low] = 1
        both += held @ held.T
    links = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(links, False)
    return links


def _settle(percent: int):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """Links that connect the members of one cluster or region as all their pairs would."""
        rows = rows.sort_values("id").drop_duplicates("id")
        ids, sets = rows["id"].to_numpy(np.int64), [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        root, links = np.arange(len(ids)), []
        if len(ids) > SMALL:
            near = all_links(sets, percent)
            while True:
                new = np.minimum(root, np.where(near, root[None, :], len(root)).min(1))
                new = new[new]
                if (new == root).all():
                    break
                root = new
            links = [(ids[i], ids[r]) for i, r in enumerate(root) if i != r]
        for i in range(len(ids) if len(ids) <= SMALL else 0):
            for j in range(i + 1, len(ids)):
                if root[i] != root[j] and linked(sets[i], sets[j], percent):
                    root[root == root[j]] = root[i]
                    links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return settle


def _confirm(percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) the links; each set travels once for each pair that it is in."""
    x = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a")
    xy = x.join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
    return xy.mapInPandas(_confirm(percent), "a long, b long")


def _rings(classes: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each class and tree: rep, tree, ring (the DEEPEST minima from the tree's place on)."""
    n = TREES * STRIDE * 4
    trees = classes.select(*columns, "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    ring = F.substring(F.concat("signature", F.substring("signature", 1, DEEPEST * 4)), F.lit(1) + F.col("tree") * STRIDE * 4, F.lit(DEEPEST * 4))
    assert DEEPEST * 4 <= n
    return trees.select(*columns, "tree", ring.alias("ring"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, ring, rep) in order to (a, b, shared): each rep b with the one before it in its tree, where they share LEAST minima
    or more. The first and the last row of the task come with a null in place of a, and with the tree and prefix that they
    are in: a region may go on in the next task."""
    names = ["a", "b", "shared", "edge"]
    before: tuple[bytes, np.ndarray, int] | None = None
    first = True

    def edge(row: tuple[bytes, np.ndarray, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([row[2]]), pa.array([0], pa.int32()), pa.array([row[0] + row[1][:DEPTH].tobytes()])], names)

    for batch in batches:
        if not len(batch):
            continue
        key = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), -1)
        tree, ring, rep = key[:, 0], key[:, 1:].copy().view(">u4"), batch.column(1).to_numpy()
        rows = lambda i: (tree[i].tobytes(), ring[i].copy(), int(rep[i]))  # noqa: E731, B023
        if first:
            yield edge(rows(0))
        first = False
        old = before if before is not None else rows(0)
        a = np.r_[old[2], rep[:-1]]
        same = np.r_[before is not None and old[0] == tree[:1].tobytes(), tree[1:] == tree[:-1]]
        equal = np.concatenate([(ring[:1] == old[1]), ring[1:] == ring[:-1]])
        shared = np.where(same, np.logical_and.accumulate(equal, 1).sum(1), 0).astype(np.int32)
        near = np.flatnonzero(shared >= LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(rep[near]), pa.array(shared[near]), pa.nulls(len(near), pa.binary())], names)
        before = rows(-1)
    if before is not None:
        yield edge(before)


def _sorted_orders(classes: DataFrame) -> DataFrame:
    """a, b, shared: neighbours in the trees' orders and the minima that they share; and those that the cuts between tasks part."""
    rows = _rings(classes, ["rep"]).select(F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), "ring").alias("key"), "rep")
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count() * TREES // RANGE)
    ranged = stored(rows, "rings").repartitionByRange(n, "key").sortWithinPartitions("key", "rep")
    found = stored(ranged.mapInArrow(_neighbours, "a long, b long, shared int, edge binary"), "neighbours")
    edges = found.filter(F.col("edge").isNotNull())  # two rows a task
    ties = edges.groupBy("edge").agg(F.min("b").alias("a")).join(edges.select("edge", "b"), "edge").filter(F.col("a") < F.col("b"))
    return found.filter(F.col("edge").isNull()).select("a", "b", "shared").union(ties.select("a", "b", F.lit(DEPTH).alias("shared")))


def _fits(n: Column, load: Column) -> Column:
    """Whether so many members with so many shingles can be settled in one place."""
    return (n <= REGION) & (load <= LOAD)


def _parts(n: Column, load: Column) -> Column:
    return F.ceil(F.greatest(n / REGION, load / LOAD)).cast("int")


def _large_clusters(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links within clusters of more than SMALL members(id, size), or of more than LOAD shingles."""
    if members.limit(1).count() == 0:
        return None
    rings = _rings(classes.drop("size").join(members, classes["rep"] == members["id"]), ["id", "size"])
    depth = [F.xxhash64("tree", F.substring("ring", 1, d * 4)) for d in range(DEPTH, DEEPEST + 1)]
    rings = stored(rings.withColumns({f"p{i}": p for i, p in enumerate(depth)}), "rings")
    region, last = rings, len(depth) - 1
    for i in range(len(depth)):
        region = region.join(rings.groupBy(f"p{i}").agg(F.count("*").alias(f"n{i}"), F.sum("size").alias(f"l{i}")), f"p{i}")
    of = lambda i: (F.col(f"n{i}"), F.col(f"l{i}"))
    cut = F.col(f"p{last}")
    part = F.when(~_fits(*of(last)), F.pmod(F.xxhash64("id"), _parts(*of(last)))).otherwise(F.lit(0))
    for i in reversed(range(last)):
        cut = F.when(_fits(*of(i)), F.col(f"p{i}")).otherwise(cut)
        part = F.when(_fits(*of(i)), F.lit(0)).otherwise(part)
    region = stored(region.select("id", "tree", "ring", F.xxhash64(cut, part).alias("region"), cut.alias("wide"), F.col("p0").alias("whole"), F.when(~_fits(*of(0)), _parts(*of(0))).alias("parts")), "regions")
    dense = region.filter(F.col("parts").isNotNull()).select("id", "tree", "whole", "parts")
    crowded = dense.limit(1).count() > 0
    links = None
    group = members.select("id", F.col("id").alias("component"))
    for first, last in TURNS:
        some = region.filter(F.col("tree").between(first, last)).join(group, "id")
        each = some.groupBy("region").agg(F.min(F.struct("id", "component")).alias("m"), F.max("component").alias("most"), F.min("component").alias("least"), F.min("wide").alias("wide"))
        each = stored(each, "turn")
        apart = some.join(each.filter(F.col("least") < F.col("most")).select("region"), "region").select("id", "region")
        settled = apart.join(sets, "id").groupBy("region").applyInPandas(_settle(percent), "a long, b long")
        # parts of one dense region are tied by their smallest members
        low = each.groupBy("wide").agg(F.min("m").alias("l"))
        ties = each.join(low, "wide").filter(F.col("l.component") != F.col("m.component")).select(F.col("l.id").alias("a"), F.col("m.id").alias("b")).distinct()
        new = stored(settled.union(_confirmed(ties, sets, percent)), "confirmed")
        links = new if links is None else links.union(new)
        group = _grouped(members, links)
        if crowded:
            links = links.union(stored(_across(dense.filter(F.col("tree").between(first, last)), group, sets, percent), "across"))
            group = _grouped(members, links)
    return links


def _grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of all members, by the links so far."""
    group = members.select("id").join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return stored(group, "groups")


def _across(dense: DataFrame, group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the regions dense(id, whole, parts): every two of their parts, unless they are connected."""
    differ = F.min("component") < F.max("component")
    some = dense.join(group, "id")
    some = some.join(some.groupBy("whole").agg(differ.alias("open")).filter("open").select("whole"), "whole")
    some = some.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = some.select("id", "component", F.xxhash64("whole", F.least("own", "other"), F.greatest("own", "other")).alias("region"))
    apart = dealt.join(dealt.groupBy("region").agg(differ.alias("open")).filter("open").select("region"), "region").select("id", "region")
    return apart.join(sets, "id").groupBy("region").applyInPandas(_settle(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id, kept: links join documents whose sets of five-word shingles
    (words by white space, A-Z lowered; a shorter text is one shingle) share at least percent of their union.

    component_id: the smallest doc_id that links reach; kept: it is the document's own. Null and empty texts have no shingle
    and are linked with nothing; a null doc_id is linked with nothing, has no component and is kept. Rows that repeat a doc_id
    are taken for one document, so what one row is linked with the other is too. Other columns are ignored; an empty table
    gives an empty one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(texts.mapInArrow(_signed, "doc_id long, n_shingles long, set_key binary, signature binary"), "signed")
    real = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"), F.min("n_shingles").alias("size")), "classes")
    near = stored(_sorted_orders(classes), "near")
    clusters = components(near.filter(F.col("shared") >= DEPTH).select("a", "b"))
    sized = clusters.join(classes.groupBy(F.col("rep").alias("id")).agg(F.max("size").alias("size")), "id")
    sizes = sized.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("load"))
    members = stored(sized.join(sizes, "component").select("id", "size", F.col("component").alias("cluster"), ((F.col("n") <= SMALL) & (F.col("load") <= LOAD)).alias("small")), "members")
    of = members.select("id", "cluster")
    sparse = near.filter(F.col("shared") < DEPTH).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sparse = sparse.join(of.withColumnsRenamed({"id": "a", "cluster": "ca"}), "a", "left").join(of.withColumnsRenamed({"id": "b", "cluster": "cb"}), "b", "left")
    sparse = stored(sparse.filter(F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ca") != F.col("cb"))).select("a", "b"), "sparse")
    some = members.select("id").union(sparse.select("a")).union(sparse.select("b")).distinct()
    wanted = texts.join(some, texts["doc_id"] == some["id"], "left_semi")
    sets = stored(wanted.mapInArrow(_sets, "id long, shingles binary"), "sets")
    small = members.filter("small").join(sets, "id").select("cluster", "id", "shingles")
    links = small.groupBy("cluster").applyInPandas(_settle(percent), "a long, b long")
    large = _large_clusters(members.filter("NOT small").select("id", "size"), classes, sets, percent)
    links = links.union(_confirmed(sparse, sets, percent))
    links = stored(links if large is None else links.union(large), "links")
    found = components(links)
    named = classes.join(found, classes["rep"] == found["id"], "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.join(named, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose five-word shingles share at least 85 % of their union."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85)



#: Links by brute force over all pairs that share a shingle, then the smallest id reachable, for DuckDB.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, b AS c FROM t UNION SELECT r.id, t.b FROM r JOIN t ON r.c = t.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, n.n AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept FROM n LEFT JOIN m ON doc_id = id
"""
