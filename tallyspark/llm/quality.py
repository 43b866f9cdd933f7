"""Quality scores by compression: texts are compressed with a dictionary built from good labelled text and with one built
from bad, and the difference of the normalised sizes becomes a calibrated score.

Sizes are normalised by the text's own. The score is a logistic curve of a difference, a times the size with the bad dictionary
less b times that with the good one, where a and b are fitted but never negative: a text that the good dictionary shrinks
better never scores less, and one that the bad dictionary shrinks better never more. With a > b, which the labels ask for, a
word repeated a thousand times, small with any dictionary, is no good text.
Half of the sampled labelled documents fill the dictionaries, the other half fit the curve: a document that is in a dictionary
would look better than it is. Only sizes and these weights are learnt; source, language, ids and labels are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, table

#: Labelled documents of each class that are sampled at most (half for the dictionaries, half for the curve).
SAMPLE = 3000
#: Bytes of the pieces that a dictionary is trained on, of a dictionary, of what is compressed at once; bytes that a frame takes.
PIECE, DICTIONARY, CHUNK, FRAME, LEVEL = 2048, 1 << 16, 1 << 14, 8, 3
#: Rows with this remainder of crc32(doc_id as text) mod FOLDS are held out: never learnt from.
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the curve's constant and weights of the sizes with the good and the bad one; without dictionaries every
    score is the rate of good labels."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float] | None
    rate: float


def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    made = []
    for d in (good, bad):
        words = zstandard.ZstdCompressionDict(d)
        words.precompute_compress(LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False, write_dict_id=False))
    return made


def sizes(texts: pa.Array, good: bytes, bad: bytes) -> np.ndarray:
    """Bytes of each whole text compressed with either dictionary, piece by piece, and as it is."""
    by = compressors(good, bad)
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        for k in range(0, max(1, len(data)), CHUNK):
            part = data[k : k + CHUNK]
            out[i, :2] += [len(c.compress(part)) for c in by]
        out[i, 2] = len(data)
    return out


def ratios(s: np.ndarray) -> np.ndarray:
    """Compressed sizes, with the good dictionary as a loss and the bad one as a gain, by the size of the text."""
    return np.c_[-s[:, 0], s[:, 1]] / (s[:, 2:] + FRAME)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[float, np.ndarray]:
    """Constant and weights, none negative, of a ridge logistic regression by damped Newton steps. What would get a negative
    weight gets none."""
    used = np.arange(x.shape[1])
    while True:
        mean, spread = x[:, used].mean(0), x[:, used].std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x[:, used] - mean) / spread]
        w = np.zeros(z.shape[1])
        keep = np.r_[0.0, np.full(len(w) - 1, ridge)]
        loss = lambda w: np.logaddexp(0, np.where(y > 0.5, -1, 1) * (z @ w)).sum() + (keep * w * w).sum() / 2  # noqa: E731, B023
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (y - p) - keep * w)
            scale, now = 1.0, loss(w)
            while scale > 1e-4 and loss(w + scale * step) > now:
                scale /= 2
            w = w + scale * step
            if np.abs(scale * step).max() < 1e-8:
                break
        slope = w[1:] / spread
        if (slope >= 0).all():
            out = np.zeros(x.shape[1])
            out[used] = slope
            return float(w[0] - (slope * mean).sum()), out
        used = used[slope > slope.min()]


def probabilities(model: Model, s: np.ndarray) -> np.ndarray:
    if model.curve is None:
        return np.full(len(s), model.rate)
    constant, good, bad = model.curve
    return 1 / (1 + np.exp(-np.clip(constant + ratios(s) @ [good, bad], -40, 40)))


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of whole texts, in pieces."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to find what recurs in: the text itself serves
        return b"".join(pieces)[-DICTIONARY:]


def _dictionaries(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "text"])
    return pd.DataFrame({"quality": [rows["quality"].iloc[0]], "words": [dictionary([t.encode() for t in rows["text"]])]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels(doc_id, quality) on docs(doc_id, text).

    At most `sample` labelled documents of each class are read, those with the lowest md5 of doc_id, held-out rows left out;
    half of them, whole, go into dictionaries, each made in one task, and of the others three sizes reach the driver. With only
    one class, or none, there is no model but the (smoothed) rate of good labels."""
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).withColumn("order", F.md5(F.col("doc_id").cast("string")))
    chosen = [r for q in (0, 1) for r in known.filter(F.col("quality") == q).orderBy("order", "doc_id").limit(sample).collect()]
    n_good = sum(r["quality"] for r in chosen)
    plain = Model(b"", b"", None, (n_good + 1) / (len(chosen) + 2))
    if not 0 < n_good < len(chosen):
        return plain
    ids = spark.createDataFrame([(r["doc_id"], r["quality"], i % 2) for i, r in enumerate(chosen)], "doc_id long, quality int, half int")
    rows = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id"), "labelled")  # at most 2 * sample ids
    # at most sample / 2 texts in a group
    made = rows.filter((F.col("half") == 0) & (F.length("text") > 0)).groupBy("quality").applyInPandas(_dictionaries, "quality int, words binary").collect()
    words = {r["quality"]: bytes(r["words"]) for r in made}
    if len(words) < 2:
        return plain
    good, bad = words[1], words[0]
    fit = rows.filter(F.col("half") == 1).select("doc_id", "quality", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sizes(b.column(2), good, bad)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s[:, i]) for i in range(3))], ["doc_id", "quality", "a", "b", "n"])

    found = fit.mapInArrow(measure, "doc_id long, quality int, a double, b double, n double").orderBy("doc_id").collect()
    y = np.array([r["quality"] for r in found], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return plain
    # the classes are sampled alike; the constant is moved to their shares among all labels
    share = known.groupBy("quality").count().collect()
    n = {r["quality"]: r["count"] for r in share}
    constant, (a, b) = logistic(ratios(np.array([[r["a"], r["b"], r["n"]] for r in found])), y)
    constant += np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, (float(constant), float(a), float(b)), plain.rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) with column _score added (one that is there is replaced): the probability of a good label, of whole
    texts; null is empty. Every row gets a score, repeated ones the same; an empty table gives an empty one."""
    docs = docs.drop("_score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sizes(b.column(at), model.good, model.bad) if model.curve else np.zeros((len(b), 3))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probabilities(model, s))], [*b.schema.names, "_score"])

    return docs.mapInArrow(run, docs.withColumn("_score", F.lit(0.0)).schema)


def rejected_removed(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that a model trained on them and labels scores at least `accept`."""
    return score(docs, train(docs, labels)).filter(F.col("_score") >= accept).drop("_score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows that are held out were not learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= ACCEPT).cast("int").alias("predicted"))
