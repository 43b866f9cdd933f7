"""Packing: an exact round trip of ids, full sequences, the tokenizer's own ids."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import packing


def test_ids_are_the_tokenizers(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", "Hello, world", "é ñ\n\n  x", "<|endoftext|>", "a" * 3000, "🙂 1234567 don't", "\x00\x01   z"]:
        assert packing.Encoder()(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_round_trip(spark, documents, edge_rows):
    rows = edge_rows + [(100 + i, f"document {i} " + "has some words of its own " * (i * 37 % 900)) for i in range(400)]
    df = documents(rows).coalesce(2)
    pieces = packing.pack(df).collect()
    encode = packing.Encoder()
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        parts[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for i, text in rows:
        if [r[0] for r in rows].count(i) > 1:
            continue
        own = sorted(parts[i], key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own])
        assert ids.tolist() == encode(text).tolist() and all(p["doc_tokens"] == len(ids) for p in own)
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [0, *np.cumsum([p["length"] for p in s])[:-1]]
        n = sum(p["length"] for p in s)
        assert n <= 2048
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 2 * 2048 and padding / total < 0.02
    groups = defaultdict(int)
    for s in sequences.values():
        groups[s[0]["step_group"]] += sum(p["length"] for p in s)
    assert max(groups.values()) <= packing.STEP
    got = packing.digest(packing.pack(df)).first()
    one = next(p for p in pieces if (p["doc_id"], p["start"]) == (got["doc_id"], got["start"]))
    assert got["ids_crc32"] == zlib.crc32(one["ids"])


def test_empty_table(spark, documents):
    assert packing.pack(documents([(1, "x")]).filter(F.lit(False))).count() == 0


def test_added_tokens_are_the_tokenizers(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext", "no such token", "é<|endoftext|>  x"]
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    assert 50256 in want[0]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(documents([*enumerate(texts)]).coalesce(1)).collect()}
    assert got == want
