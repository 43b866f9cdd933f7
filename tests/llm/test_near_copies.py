"""Near-duplicates, repeated strings and near vectors against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import caps, graphs, minhash, shingles, suffixes


def reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {i: find(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r["id"]: r["component"] for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == reachable({x for pair in links if pair[0] != pair[1] for x in pair}, links)
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_against_brute_force(spark, documents, edge_rows):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [r for r in edge_rows if r[0] is not None]
    n = 1000
    for size, copies, edits in ((120, 90, 1), (120, 90, 2), (60, 4, 1), (400, 3, 4), (5, 3, 0), (4, 3, 0)):
        base = [rng.choice(words) for _ in range(size)]
        for c in range(copies):
            text = list(base)
            for _ in range(edits if c else 0):
                text[rng.randrange(size)] = rng.choice(words)
            rows.append((n, (" " if c % 2 else "\n").join(text).upper() if c % 3 == 0 else " ".join(text)))
            n += 1
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = reachable(ids, links)
    out = minhash.near_duplicates(documents(rows), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_dense_regions_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "REGION", 8)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base, rows = [rng.choice(words) for _ in range(196)], []
    for c in range(80):  # below the threshold with all others, but for a twin
        one = list(base)
        for _ in range(2):
            one[rng.randrange(196)] = rng.choice(words)
        twin = list(one)
        twin[rng.randrange(196)] = rng.choice(words)
        rows += [(2 * c, " ".join(one)), (2 * c + 1, " ".join(twin))]
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    out = minhash.near_duplicates(documents(rows), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == reachable(ids, links)


def test_pairs_near_the_threshold_are_found(spark, documents):
    """Recall around many different texts: pairs that share 80 to 86 % of their shingles, at 80."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(20000)]
    rows, want = [], 0
    for c in range(300):
        one = [rng.choice(words) for _ in range(150)]
        two = list(one)
        for k in rng.sample(range(10, 140), 2 + c % 2):
            two[k] = rng.choice(words)
        rows += [(2 * c, " ".join(one)), (2 * c + 1, " ".join(two))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        want += 100 * len(a & b) >= 80 * len(a | b)
    out = minhash.near_duplicates(documents(rows), 80).collect()
    found = sum(not r["kept"] for r in out)
    assert want >= 250 and want * 0.995 <= found <= want


def test_neighbours_in_sorted_orders():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rings = rng.integers(0, 3, (200, minhash.DEEPEST)).astype(">u4")
    rows = sorted((bytes([t]) + r.tobytes(), i) for t in (0, 1) for i, r in enumerate(rings))
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[a : a + 37]]), pa.array([i for _, i in rows[a : a + 37]])], ["key", "rep"]) for a in range(0, len(rows), 37)]
    out = [r for b in minhash._neighbours(iter(batches)) for r in b.to_pylist()]
    want = []
    for (x, i), (y, j) in zip(rows, rows[1:]):
        shared = 0
        while x[0] == y[0] and shared < minhash.DEEPEST and x[1 + 4 * shared : 5 + 4 * shared] == y[1 + 4 * shared : 5 + 4 * shared]:
            shared += 1
        if shared >= minhash.LEAST:
            want.append((i, j, shared))
    assert [(r["a"], r["b"], r["shared"]) for r in out if r["edge"] is None] == want
    assert [(r["b"], r["edge"][0]) for r in out if r["edge"] is not None] == [(rows[0][1], 0), (rows[-1][1], 1)]


def test_near_duplicates_edges(spark, documents, edge_rows):
    out = minhash.near_duplicates(documents(edge_rows)).collect()
    assert len(out) == len(edge_rows) and all(r["kept"] == (r["doc_id"] != 5) for r in out)
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (2, 2), (3, 3), (None, None), (4, 4), (5, 4), (6, 6), (7, 7)}
    assert minhash.near_duplicates(documents(edge_rows).limit(0)).count() == 0


def test_long_texts_go_in_parts(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"word{i}" for i in range(5000)) + " " + "x" * 3000
    whole = next(shingles.shingle_sets(pa.array([text])))
    monkeypatch.setattr(shingles, "CHUNK", 700)
    assert (next(shingles.shingle_sets(pa.array([text]))) == whole).all()


def kept_bytes(rows, length=50):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, int)
        own = set()
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if seen.get(s, i) < i:
                gone[k] += 1
                gone[k + length] -= 1
            own.add(s)
        for s in own:
            seen.setdefault(s, i)
        cut = np.cumsum(gone)[: len(data)] > 0
        rest = bytes(np.frombuffer(data, np.uint8)[~cut])
        out[i] = (len(data), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


def test_orders_of_suffixes():
    rng = np.random.default_rng(1)
    slices = [bytes(rng.integers(97, 97 + k, n).astype(np.uint8)) for k in (1, 2, 20) for n in (50, 51, 52, 77, 80) for _ in range(4)]
    chunk = suffixes.Chunk(np.array([len(s) for s in slices], np.int64).tobytes(), b"".join(slices))
    data = b"".join(slices)
    assert [tuple(x) for x in zip(*chunk.triples)] == sorted({tuple(int.from_bytes(data[i + a : i + b], "big") for a, b in ((0, 7), (7, 14), (14, 20))) for i in chunk.sample})
    names = np.arange(len(chunk.first)) * 3 + 1
    for residues in suffixes.ORDERS:
        which, first, keys = chunk.ordered(names, residues)
        assert {int(r) for r in chunk.inner[chunk.windows[which]] % 3} == set(residues)
        windows = [data[i : i + 50] for i in chunk.windows[which]]
        assert windows == sorted(windows) and [windows[i] for i in first] == sorted(set(windows))
        keys = list(zip(*keys))
        assert keys == sorted(set(keys)) and len(keys) == len(first)


def test_repeats_against_brute_force(spark, documents, edge_rows, monkeypatch):
    rng = random.Random(2)
    words = ["the", "of", "and", "é", "river", "stone", "light", "under", "above", "when"]
    passage = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = [r for r in edge_rows if r[0] is not None and r != (5, "one")] + [(5, "one")]
    for i in range(120):
        own = " ".join(f"{rng.choice(words)}{rng.randrange(9999)}" for _ in range(80))
        p = rng.choice(passage)
        a, b = sorted(rng.sample(range(len(p)), 2))
        rows.append((100 + i, own[: rng.randrange(len(own))] + p[a:b] + own[::-1][:90] if i % 3 else own + p))
    rows += [(500 + i, rows[20 + i % 5][1]) for i in range(30)] + [(600, "ab" * 400), (601, "ab" * 300), (602, "a" * 49), (603, "a" * 49), (604, "a" * 50), (605, "a" * 50)]
    want = kept_bytes(rows)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.remove_repeats(documents(rows)).collect()}
    assert got == want
    monkeypatch.setattr(suffixes, "CHUNK", 1000)  # equal windows meet across many chunks and ranges
    monkeypatch.setattr(suffixes, "RANGE", 500)
    again = suffixes.remove_repeats(documents(rows).repartition(7)).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in again} == {i: w[3] for i, w in want.items()}


def test_repeats_of_a_passage_in_a_third_of_all_texts(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 5000)
    rng = random.Random(6)
    passage = "this passage of somewhat more than fifty bytes is in very many texts"
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = [(i, " ".join([word() for _ in range(12)] + [passage[i % 7 :]] * (i % 3 == 0) + [word() for _ in range(12)])) for i in range(900)]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.remove_repeats(documents(rows)).collect()}
    assert got == kept_bytes(rows)


def test_rows_that_share_a_doc_id_are_judged_each(spark, documents):
    a, b, c = ("".join(random.Random(k).choice("abcdefghijklm ") for _ in range(120)) for k in (1, 2, 3))
    rows = [(1, a), (2, "x" + a), (2, b + "y"), (2, "z" + b), (3, b), (3, c), (None, c + a), (4, c[:60] + "q"), (4, c[:60] + "q")]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(documents(rows)).collect())
    assert got == [(0, 240, 0), (1, 120, 0), (2, 121, 0), (2, 121, 0), (2, 121, 120), (3, 120, 0), (3, 120, 120), (4, 61, 60), (4, 61, 60)]


def test_repeats_edges(spark, documents, edge_rows):
    out = suffixes.remove_repeats(documents(edge_rows)).collect()
    assert len(out) == len(edge_rows) and not any(r["n_removed"] for r in out)
    assert suffixes.remove_repeats(documents(edge_rows).limit(0)).count() == 0


def test_near_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24))
    near = np.concatenate([base[i] + rng.standard_normal((k, 24)) * s for i, k, s in ((0, 60, 0.05), (1, 5, 0.3), (2, 5, 0.2), (3, 1, 0.0))])
    x = np.concatenate([base, near, base[4:5] * 7])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [1.0, None] + [0.0] * 22), (905, [float("inf")] + [0.0] * 23), (906, [1e-300] * 24), (907, [1e300] * 24)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(a, b) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)))] + [(906, 907)]
    want = reachable([*range(len(x)), *(i for i, _ in odd)], links)
    n = {i: sum(i in p for p in links) for i in want}
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1))
    for block in (caps.BLOCK, 16):
        monkeypatch.setattr(caps, "BLOCK", block)
        out = caps.near_vectors(df).collect()
        found = sum(r["n_links"] for r in out) / 2
        assert len(out) == len(want) and found <= len(links) and found >= 0.97 * len(links)
        assert sum(want[r["vec_id"]] == r["component_id"] for r in out) >= 0.97 * len(want)
        assert all(r["n_links"] <= n[r["vec_id"]] for r in out)
    assert caps.near_vectors(df.limit(0)).count() == 0


def planted_pairs(n, dim, cosine, seed):
    """Pairs of unit vectors at a cosine, around n different vectors."""
    rng = np.random.default_rng(seed)
    a, b = caps.normalised(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    b = caps.normalised(b - (a * b).sum(1, keepdims=True) * a)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * b


def test_planted_pairs_list_a_common_filter():
    for n, pairs in ((1000, 1000), (100_000, 1000), (1_000_000, 500)):
        code = caps.Code(n, 64)
        for cosine in (0.901, 0.95, 0.99):
            a, b = (code.lists(x) for x in planted_pairs(pairs, 64, cosine, 11))
            assert all(len(x) for x in a)
            assert sum(not set(x) & set(y) for x, y in zip(a, b)) <= pairs * 0.005


def test_links_around_many_vectors(spark):
    parts = [planted_pairs(250, 64, cosine, seed) for cosine, seed in ((0.901, 1), (0.95, 2), (0.99, 3))]
    x = np.concatenate([v for pair in parts for v in pair])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = int((np.triu(x @ x.T, 1) >= 0.9).sum())
    out = caps.near_vectors(df).collect()
    assert sum(r["n_links"] for r in out) / 2 >= 0.995 * want and want >= 750


def test_regions_are_bounded_by_their_shingles(spark, documents, monkeypatch):
    """Few members with many shingles are settled in parts, with the same links."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, seen = [], []
    for g in range(3):
        base = [word() for _ in range(600)]
        for i in range(30):
            text = list(base)
            for _ in range(rng.randrange(12)):
                text[rng.randrange(len(text))] = word()
            rows.append((1000 * g + i, " ".join(text)))
    rows += [(5000 + i, " ".join(word() for _ in range(300))) for i in range(20)]
    settle = minhash.all_links
    for small, load in ((64, 1 << 21), (64, 3000), (4, 3000)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "LOAD", load)
        seen.append(sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(documents(rows), 85).collect()))
    assert seen[0] == seen[1] == seen[2] and len({c for _, c in seen[0]}) < len(rows) - 60
    assert settle([np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64)], 80)[0, 1]
