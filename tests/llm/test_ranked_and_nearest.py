"""Lexical search, nearest neighbours and importance resampling: plain arithmetic, brute force, measured recall."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import forest, lexical, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(items, docs, k):
    """The contract, term by term."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    of = {}
    for i, t in items:
        if i is not None:
            of.setdefault(i, Counter()).update(split(t))
    out = set()
    for i, wanted in of.items():
        scores = []
        for d, c in held:
            m = 100 - 75 + 75 * c.total() * n_docs // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in wanted.items() if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])}
    return out


@pytest.fixture
def search_rows(edge_rows):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(150)] + ["Straße", "İx", "A1b", "日本"]
    text = lambda n: " ".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) for _ in range(n))
    docs = [(100 + i, text(rng.randrange(1, 80))) for i in range(300)] + [(500 + i, "same words here") for i in range(30)] + [e for e in edge_rows if e[0] != 5]
    items = [(i, text(20)) for i in range(40)] + [(50, None), (51, ""), (52, "zzz9"), (53, "same Words_here"), (None, "same"), (54, "word " * 5000), (1, "same")]
    return items, docs


def test_search_against_plain_arithmetic(spark, documents, search_rows, monkeypatch):
    items, docs = search_rows
    given = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    df = documents(docs).withColumnsRenamed({"key": "rank", "row": "terms"}).repartition(5)
    got = lambda **k: [tuple(r) for r in lexical.search(given, df, 10).collect()]
    want = ranked(items, docs, 10)
    found = got()
    assert set(found) == want and len(found) == len(want) and {i for i, *_ in want} >= {0, 1, 53, 54} and not {50, 51, 52} & {i for i, *_ in want}
    for name, value in (("DOCS", 16), ("POSTINGS", 100), ("PART", 10), ("BATCH", 1500), ("MET", 1)):
        monkeypatch.setattr(lexical, name, value)
    assert set(got()) == want
    assert lexical.search(given, df.limit(0), 10).count() == 0 and lexical.search(given.limit(0), df, 10).count() == 0


def test_search_counts_repeated_documents_each(spark, documents):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (2, "beta")]
    items = spark.createDataFrame([(7, "alpha")], "item_id long, text string")
    got = sorted(tuple(r) for r in lexical.search(items, documents(docs), 10).collect())
    assert [(i, r, d) for i, r, d, _ in got] == [(7, 1, 1), (7, 2, 1)]


def neighbours(rows, queries, k):
    """Brute force in double precision."""
    x = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x[i] = min(x[i], v) if i in x else v
    ids, mat = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    out = {}
    for q in queries:
        if q in x:
            s = (np.array(x[q]) * mat).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["clusters", "no structure", "lengths"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(5)
    n, dim = 4000, 24
    x = rng.standard_normal((n, dim))
    if kind == "clusters":
        x = rng.standard_normal((40, dim))[rng.integers(0, 40, n)] * 3 + x * 0.4
    if kind == "lengths":
        x *= rng.lognormal(0, 1, n)[:, None]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.nearest(df.filter("vec_id % 20 = 0"), df, 20).collect()
    want = neighbours(rows, range(0, n, 20), 20)
    found = {q: sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) for q in want}
    assert all([r for r, *_ in f] == [*range(1, 21)] for f in found.values())
    share = np.mean([len({v for _, v, _ in found[q]} & {v for v, _ in w}) / 20 for q, w in want.items()])
    assert share >= 0.9
    for q, f in found.items():
        assert all(v != q and abs(s - float((x[q] * x[v]).sum())) <= 1e-9 * (1 + abs(s)) for _, v, s in f)
        assert f == sorted(f, key=lambda y: (-y[2], y[1]))


def test_small_and_odd_tables(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, -0.5]) for i in range(60)] + [(100 + i, [2.0, 2.0, 2.0]) for i in range(90)]
    rows += [(200, None), (201, [0.0] * 3), (202, [float("nan"), 1.0, 1.0]), (203, [None, 1.0, 1.0]), (204, []), (205, [1.0]), (None, [1.0, 1.0, 1.0]), (40, [0.0, 1.0, -0.5]), (206, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("x")).withColumn("tree", F.lit(1))
    few = df.filter("vec_id < 9")
    monkeypatch.setattr(forest, "LEAF", 4)
    monkeypatch.setattr(forest, "BLOCK_BYTES", 400)
    monkeypatch.setattr(forest, "QUERY_BYTES", 100)
    monkeypatch.setattr(forest, "SHARE", 1.0)
    monkeypatch.setattr(forest, "HELD", 3)
    same = [(i, [*v, 0.0, 0.0][:3] if v and len(v) < 3 else v) for i, v in rows]
    for part, limit in ((df, 10**9), (few, 9)):
        got = {}
        for r in forest.nearest(part.filter("vec_id % 20 = 0"), part, 20).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        want = neighbours([(i, v) for i, v in same if i is not None and i < limit], range(0, 300, 20), 20)
        assert {q: [(v, s) for _, v, s in sorted(f)] for q, f in got.items()} == want
    assert forest.nearest(df.limit(0), df).count() == 0 and forest.nearest(few, df.limit(0)).count() == 0


def test_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0]), (4, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in forest.nearest(df.filter("vec_id = 0"), df).orderBy("rank").collect()]
    assert got == [(1, math.inf), (3, 1.0), (4, 1.0), (2, -math.inf)]


def resampled(docs, target, percent, longest, buckets, least, seed):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    def found(text):
        w = split(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    rows = [(i, *found(t)) for i, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in found(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, n, f in rows:
        weight, score = sum(map(gain, f)) // len(f) if f else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for at, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = at + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_against_plain_arithmetic(spark, documents, edge_rows, longest):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    text = lambda part, n: " ".join(rng.choice(words[part:]) for _ in range(n))
    docs = [(100 + i, text(150 * (i % 3 == 0), rng.randrange(0, 90))) for i in range(400)] + edge_rows
    target = [text(200, 60) for _ in range(20)] + [None, "", "Same_WORDS"]
    given = spark.createDataFrame([(t, 1) for t in target], "text string, s int")
    df = documents(docs).withColumnsRenamed({"key": "s", "h1": "found", "part": "bucket", "class": "rank"})
    args = {"percent": 30, "longest": longest, "buckets": 97, "least": 10, "seed": 5}
    out = resample.resample(df, given, **args)
    got, want = Counter(tuple(r) for r in out.collect()), resampled(docs, target, 30, longest, 97, 10, 5)
    assert got == want and out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    drawn = [r[0] for r in got if r[4]]
    assert sum(i >= 100 and i % 3 == 1 for i in drawn) > len(drawn) / 3  # 102, 105, ... are of the target's words
    none = resample.resample(df, given.limit(0), **args)
    assert Counter(tuple(r) for r in none.collect()) == resampled(docs, [], 30, longest, 97, 10, 5)
    assert resample.resample(df.limit(0), given, **args).count() == 0


def test_ranks_follow_the_score_across_partitions(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 13).alias("score"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one partition
    try:
        out = resample.placed(rows)
        assert out.select(F.shiftright(F.monotonically_increasing_id(), 33)).distinct().count() > 1
        got = {r["rank"]: (r["score"], r["doc_id"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [got[i] for i in range(1, 5001)] == sorted(((i * 7919 % 13, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
