"""The pipeline's stages on a small corpus with planted cases."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import zstandard
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, mixing, packing, quality


def test_stages(spark, documents, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    text = lambda n=80: " ".join(rng.choice(words) for _ in range(n))
    shared = "This very line stands in a good many of the documents here"
    good = {i: f"{text()}\n{shared}\n{text()}" for i in range(300)}
    bad = {i: " ".join(rng.choice(words) + "***" for _ in range(120)) for i in range(1000, 1100)}
    copies = {2000 + i: good[i] for i in range(20)}
    near = {3000 + i: good[100 + i] + " tail" for i in range(20)}
    rows = [*good.items(), *bad.items(), *copies.items(), *near.items(), (4000, None), (4001, "")]
    docs = documents(rows, lambda i: "a" if i % 3 else "b").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = stage["quality"](spark, d, str(tmp_path)).cache()
    kept = {r["doc_id"] for r in one.collect()}
    assert one.columns == d.columns and len(kept & set(good)) >= 297 and len(kept & set(bad)) <= 3
    two = stage["lines"](spark, one, str(tmp_path)).cache()
    assert two.columns == d.columns and two.count() == len(kept) and two.filter(F.col("text").contains(shared)).count() <= 21
    three = stage["near_duplicates"](spark, two, str(tmp_path)).cache()
    left = {r["doc_id"] for r in three.collect()}
    assert not left & set(copies) and not left & set(near) and left >= kept & set(good)
    four = stage["mixing"](spark, three, str(tmp_path)).cache()
    assert four.columns == d.columns and {r["doc_id"] for r in four.collect()} <= left
    five = stage["packing"](spark, four, str(tmp_path))
    assert five.select("doc_id").distinct().count() == four.select("doc_id").distinct().count()
    # how documents are cut depends on which ones a task reads, what is packed does not
    whole = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.sum((F.col("start") == 0).cast("int")).alias("copies")).collect())
    assert whole(corpus_pipeline.run(spark, str(tmp_path))) == whole(five)
    empty = d.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0, name


def test_stages_against_brute_force(spark, documents, edge_rows, tmp_path):
    """Every stage by plain means, on the rows that its predecessor kept."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [line(12) for _ in range(3)]
    rows = [(i, "\n".join([line(rng.randrange(1, 60)), *rng.sample(common, rng.randrange(3)), line(5)])) for i in range(250)]
    rows += [(1000 + i, " ".join(rng.choice(words).upper() + "%%" for _ in range(rng.randrange(5, 90)))) for i in range(80)]
    rows += [(2000 + i, rows[i * 3][1] + (" end" if i % 2 else "")) for i in range(60)] + [(3000 + i, t) for i, (_, t) in enumerate(edge_rows)]
    docs = documents(rows, lambda i: None if i % 7 == 0 else "abc"[i % 3]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows if i < 1080], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, given, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = given, spark.read.parquet(f"{tmp_path}/{name}")
        given = seen[name][1]
    assert list(stages) == list(seen)
    con = duckdb.connect()

    def texts(df):
        return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())

    before, after = seen["quality"]
    model = quality.train(before, labels)
    plain = lambda words: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
    good, bad = plain(model.good), plain(model.bad)

    def accepted(text):
        data = (text or "").encode()
        g, b = (sum(len(c.compress(data[i : i + quality.CHUNK])) for i in range(0, max(1, len(data)), quality.CHUNK)) for c in (good, bad))
        constant, x, y = model.curve
        return 1 / (1 + math.exp(-(constant + (y * b - x * g) / (len(data) + quality.FRAME)))) >= quality.ACCEPT

    kept = Counter({k: n for k, n in texts(before).items() if accepted(k[1])})
    assert texts(after) == kept and 0 < sum(kept.values()) < before.count()
    assert len([k for k in kept if k[0] is not None and k[0] < 250]) >= 240 and not [k for k in kept if k[0] is not None and 1000 <= k[0] < 1080]

    before, after = seen["lines"]
    con.register("given", before.filter("doc_id IS NOT NULL").dropDuplicates().toPandas())
    want = dict(con.sql(f"WITH {line_dedup.kept_sql('given')} SELECT doc_id, kept FROM deduped").fetchall())
    assert {(r["doc_id"], r["text"] or "") for r in after.collect() if r["doc_id"] is not None} == set(want.items()) and after.count() == before.count()
    assert all(r["n_chars"] == len(r["text"] or "") for r in after.collect())

    before, after = seen["near_duplicates"]
    shingles = {}
    for r in before.collect():
        if r["doc_id"] is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
            shingles[r["doc_id"]] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {i: i for i in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in shingles:
        for b in shingles:
            if a < b and shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    gone = {i for i in root if find(i) != i}
    assert texts(after) == Counter({k: n for k, n in texts(before).items() if k[0] not in gone}) and gone

    before, after = seen["mixing"]
    rows = before.select("doc_id", "text", "source").toPandas()
    con.register("rows", rows.assign(size=[len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows["text"]]))
    want = Counter()
    for i, t, s, n in con.sql(f"WITH d AS (SELECT doc_id, text, source, CAST(size AS BIGINT) AS size FROM rows),{mixing.MIX_SQL} SELECT doc_id, text, source, copies FROM mixed").fetchall():
        want[None if i is None or i != i else int(i), t, s] += n
    assert texts(after) == +want

    before, after = seen["packing"]
    encode = packing.Encoder()
    want = Counter((r["doc_id"], len(encode(r["text"]))) for r in before.collect())
    got, tokens = Counter(), 0
    for r in after.collect():
        got[r["doc_id"], r["doc_tokens"]] += r["start"] == 0
        tokens += r["length"]
    assert +got == want and tokens == sum(n * c for (_, n), c in want.items())


def test_columns_of_any_name_go_through_every_stage(spark, documents, tmp_path):
    """Columns named like those that the operators add, and others, come out as they went in."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    common = "This very line stands in a good many of the documents here"
    rows = [(i, "\n".join([" ".join(rng.choice(words) for _ in range(30)), common])) for i in range(40)] + [(100, None), (101, "")]
    names = ["_score", "_kept", "_n_lines", "_n_dropped", "_copies", "_copy", "_size", "_source_size", "_target", "more0", "a.b", "row", "rank", "kept", "component_id"]
    docs = documents(rows, lambda i: "ab"[i % 2]).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names})
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and got, name
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in got for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
