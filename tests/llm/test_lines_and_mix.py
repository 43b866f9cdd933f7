"""Line dedup and mixing against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, mixing

SPACE = " \t\n\x0b\x0c\r"


def deduped(rows, least_length=40, least_docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_length:
                docs[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(docs[key(x)]) >= least_docs and i != max(docs[key(x)]))] if docs else lines
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_against_brute_force(spark, documents):
    common, rare = "This is a line that very many documents hold, É", "Only some documents hold this line, but not five"
    rows = [(i, "\n".join([f"document {i} begins with a line of its own, long enough", "  " + (common.upper().replace("É", "É") if i % 2 else common) + "\t", rare if i < 4 else "short", common if i == 3 else "x", ""])) for i in range(70)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(f"{j} {common}" for j in range(300)) + "\n" + common)]
    got = line_dedup.line_dedup(documents(rows))
    want = deduped(rows)
    found = {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], hashlib.sha256(r["_kept"].encode()).hexdigest()) for r in got.collect()}
    assert found == want
    assert sum(v[1] for v in want.values()) > 60


def test_line_dedup_edges(spark, documents, edge_rows):
    out = line_dedup.line_dedup(documents(edge_rows)).collect()
    assert len(out) == len(edge_rows) and not any(r["_n_dropped"] for r in out)
    assert line_dedup.line_dedup(documents(edge_rows).limit(0)).count() == 0


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by giving out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, None: 70, "é": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = filled(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and abs(sum(got.values()) - 1115) < 1e-6


def test_mix_takes_near_the_targets(spark, documents):
    rows = [(i, "w " * (i * 7919 % 50)) for i in range(3000)]
    df = documents(rows, lambda i: None if i % 10 == 0 else "big" if i % 3 else f"s{i % 4}")
    out = [r.asDict() for r in mixing.mix(df).select("doc_id", "source", "_size", "_source_size", "_target", "_copies").collect()]
    taken = Counter()
    for r in out:
        assert 0 <= r["_copies"] <= 3 and r["_size"] == r["doc_id"] * 7919 % 50
        taken[r["source"]] += r["_copies"] * r["_size"]
    for r in out:
        assert abs(taken[r["source"]] - r["_target"]) <= 60
    again = {(r["doc_id"], r["_copies"]) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["_copies"]) for r in out}


def test_mix_edges(spark, documents, edge_rows):
    df = documents(edge_rows)
    out = mixing.mix(df)
    assert out.count() == len(edge_rows) and set(df.columns) < set(out.columns)
    assert {r["_size"] for r in out.filter(F.col("doc_id").isin(1, 2, 3)).collect()} == {0}
    assert mixing.mix(df.limit(0)).count() == 0
    assert len(re.findall(mixing.WORD, "a\x1cb c")) == 2
