"""Hierarchical packing of tokenised documents into sequences of several context sizes.

A document gives as many full windows of the largest size as it holds; its rest is routed to the smallest tier that it fits.
Each tier is packed from the largest down: a rest opens a sequence, and its gap is filled by the longest rests of shorter
tiers that fit, then closed by cutting one of them to measure. So sequences are full, but for the last one of a task.
Sequences of one tier are dealt to step groups that hold equally many tokens, whatever their context size.

Packing needs no shuffle: a task packs the documents that it reads, in blocks of bounded size, while it tokenises them. What
a task holds is one block; a lost task is run again with the same result.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table

#: Context sizes, largest first; tokens in a block; tokens that a step group takes; the id that ends a document.
TIERS, BLOCK, STEP, END = (2048, 1024, 512, 256), 1 << 21, 1 << 15, 1
#: Bits of a sequence's number within its task.
LOCAL = 40


class Encoder:
    """Ids of byte_bpe_50k.json, added tokens too. Its ranks in the other library give the same ids several times faster (tests
    compare them)."""

    _made: dict[str, object] = {}

    def __init__(self, name: str = "byte_bpe_50k"):
        if name not in self._made:
            import public_tokenizers
            import tiktoken

            with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
                added = {t["content"]: int(t["id"]) for t in json.load(f)["added_tokens"]}
            self._made[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.ids = partial(self._made[name].encode, allowed_special="all", disallowed_special=())

    def __call__(self, text: str | None) -> np.ndarray:
        return np.array([*self.ids(text or ""), END], "<u4")


class Packer:
    """Packs the documents of one task. Pieces are (document, start, length); a document is its index in docs."""

    def __init__(self, tiers: tuple[int, ...], step: int, task: int):
        self.tiers, self.step, self.next = tiers, step, task << LOCAL
        self.filled, self.pool, self.out = dict.fromkeys(tiers, 0), [], []

    def emit(self, tier: int, pieces: list[tuple[int, int, int]]) -> None:
        group, at = (self.tiers.index(tier) << 34) + self.filled[tier] // self.step, 0
        self.filled[tier] += tier
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.next, at, tier, group))
            at += length
        self.next += 1

    def add(self, doc: int, n: int) -> None:
        """All tokens of a document: full windows at once, the rest into the pool."""
        start = 0
        while n - start >= self.tiers[0]:
            self.emit(self.tiers[0], [(doc, start, self.tiers[0])])
            start += self.tiers[0]
        if start < n:
            insort(self.pool, (n - start, doc, start))

    def fill(self, tier: int, pieces: list[tuple[int, int, int]], gap: int) -> int:
        """Fills pieces up with the longest rests that fit, then with a cut one; returns the gap that is left without rests."""
        while gap and self.pool:
            i = bisect_right(self.pool, (gap, 1 << 62, 0)) - 1
            length, doc, start = self.pool.pop(i if i >= 0 else -1)
            take = min(length, gap)
            pieces.append((doc, start, take))
            gap -= take
            if take < length:
                insort(self.pool, (length - take, doc, start + take))
        return gap

    def pack(self, last: bool) -> None:
        """Packs the pool tier by tier; rests that no tier takes wait for the next block, or share the last sequences."""
        for tier in self.tiers:
            while self.pool and self.pool[-1][0] > tier // 2:
                if not last and sum_at_most(self.pool, tier):
                    return
                i = bisect_left(self.pool, (tier + 1, 0, 0)) - 1
                length, doc, start = self.pool.pop(i)
                pieces = [(doc, start, length)]
                gap = self.fill(tier, pieces, tier - length)
                self.emit(tier if not gap else self.tiers[0], pieces)
        while self.pool and (last or not sum_at_most(self.pool, self.tiers[-1])):
            pieces: list[tuple[int, int, int]] = []
            gap = self.fill(self.tiers[-1], pieces, self.tiers[-1])
            self.emit(self.tiers[-1] if not gap else self.tiers[0], pieces)


def sum_at_most(pool: list[tuple[int, int, int]], n: int) -> bool:
    """Whether all rests together are shorter than n."""
    total = 0
    for length, *_ in reversed(pool):
        total += length
        if total >= n:
            return False
    return True


def _packed(tiers: tuple[int, ...], step: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(), Packer(tiers, step, TaskContext.get().partitionId())
        docs: dict[int, tuple[object, np.ndarray]] = {}
        count = held = 0

        def pieces() -> Iterator[pa.RecordBatch]:
            done, packer.out = packer.out, []
            for i in range(0, len(done), 20_000):
                part = done[i : i + 20_000]
                ids = [docs[d][1][s : s + n].tobytes() for d, s, n, *_ in part]
                of, start, length, seq, at, tier, group = zip(*part, strict=True)
                cols = [pa.array([docs[d][0] for d in of], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([len(docs[d][1]) for d in of], pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64()), pa.array(tier, pa.int32()), pa.array([(packer.next >> LOCAL << LOCAL) + g for g in group], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"])
            left = {d for _, d, _ in packer.pool}
            for d in [d for d in docs if d not in left]:
                del docs[d]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py())
                docs[count] = (doc_id, ids)
                packer.add(count, len(ids))
                count, held = count + 1, held + len(ids)
                if held >= block:
                    packer.pack(False)
                    yield from pieces()
                    held = 0
        packer.pack(True)
        yield from pieces()

    return run


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) to one row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, tier, step_group, ids.

    ids: the piece's ids as little-endian unsigned 32-bit. tier: the sequence's context size; a sequence that is not full has
    the largest and is to be padded to it. A null or empty text is the end id alone. Repeated rows are documents of their
    own, null doc_ids stay null, other columns are ignored; an empty table gives no piece."""
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packed(tuple(sorted(tiers, reverse=True)), step, block), schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return digest(pack(table(spark, sf_dir, "documents")))
